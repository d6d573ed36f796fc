"""Reading of noisy text: word counts, usual character confusions, and the cheapest path through the words of a de-lined stream."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from typing import NamedTuple

# What OCR reads -> what was printed.
CONFUSIONS = {
    "c": "e", "f": "t", "1": "il", "!": "i", "|": "il", "u": "n", "à": "a", "0": "o", "5": "s", "(": "c", "b": "h", "9": "g", "8": "b", "7": "t", "l": "i", "i": "l",
    "cl": "d", "ii": "u", "rn": "m", "vv": "w", "m": ("rn",), "d": ("cl",), "h": ("ti", "li"),
}
#: Letters read in place of digits, within numbers.
AS_DIGITS = str.maketrans("OoQDIl|!iZzSsBGg", "0000111112255866")
HYPHENS = "-¬­‐"
_EDGE = " \t.,;:\"'“”‘’|()[]{}<>¿?¡!…*_=~«»/\\"
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_LATIN_RUN = re.compile(r"[A-Za-zÀ-ɏ0-9$%.,!|(<-]{2,}")
_NUMBER = re.compile(r"[-+(]*[$€£]?\d{1,3}(,\d{3})*(\.\d+)?%?\)?|[-+(]*[$€£]?\d+([.,]\d+)?%?\)?|\d{1,4}([-/.]\d{1,4}){1,2}|\d{1,2}:\d{2}(:\d{2})?")
_CODE = re.compile(r"([A-Z]{2,4})-(\d+)")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

# The strokes letters are made of. What is read and what was printed have the same strokes in every confusion above.
_STROKES = str.maketrans({
    "e": "c", "(": "c", "f": "l", "t": "l", "7": "l", "1": "l", "i": "l", "!": "l", "|": "l", "à": "a", "0": "o", "5": "s", "9": "g",
    "u": "ll", "n": "ll", "h": "ll", "b": "ll", "8": "ll", "d": "cl", "m": "rll", "w": "vv",
})

#: Most places of one word that may be misread.
MOST_SPOTS = 3
#: Parts of all words of the documents. A word of FREQUENT or more stands as it is; at most 1 / FREQUENT words can be so frequent, whatever the documents. A reading must be at least LEAST.
FREQUENT, LEAST = 1e-5, 1e-6
#: A reading must be so many times as frequent as the word as it stands.
RATIO = 300
#: Costs are negative logarithms of parts of all words: of a word never seen, of one misread place, of further ones, and of joining or parting tokens.
UNSEEN, MISREAD, FURTHER, JOINED = -math.log(LEAST / RATIO), math.log(RATIO), 1.0, 2.0


def strokes(word: str) -> str:
    """Equal for a word and all its misreadings, and for some other words."""
    return word.translate(_STROKES)


def spots(read: str, printed: str) -> tuple[int, ...] | None:
    """The fewest places (at most MOST_SPOTS) at which `printed` was misread so that `read` came out; None if it can't have been."""
    if read == printed:
        return ()
    # fewest misread places that lead to (place in read, place in printed), cheapest first
    front: dict[tuple[int, int], tuple[int, ...]] = {(0, 0): ()}
    for used in range(MOST_SPOTS + 1):
        following: dict[tuple[int, int], tuple[int, ...]] = {}
        for (i, j), at in front.items():
            while True:
                if used < MOST_SPOTS:
                    for width in (1, 2):
                        for true in CONFUSIONS.get(read[i : i + width], ()) if i + width <= len(read) else ():
                            if printed.startswith(true, j):
                                following.setdefault((i + width, j + len(true)), (*at, i))
                if i < len(read) and j < len(printed) and read[i] == printed[j]:
                    i, j = i + 1, j + 1
                else:
                    break
            if i == len(read) and j == len(printed):
                return at
        front = following
    return None


class Found(NamedTuple):
    """What is known of a form that isn't a frequent word: its part of all words, and its reading with its part and the places misread."""

    part: float
    word: str
    word_part: float
    places: tuple[int, ...]


def found(form: str, part: float, near: Iterable[tuple[str, float]]) -> Found | None:
    """The reading of a form among words with its strokes: the fewest places, then the most frequent word, then the first by code points."""
    best = None
    for word, of in near:
        if word != form and of >= max(LEAST, part * RATIO) and len(form) > 1 and (at := spots(form, word)):
            best = min(best or (9, 0.0, "", ()), (len(at), -of, word, at))
    if best is None:
        return Found(part, form, part, ()) if part else None
    return Found(part, best[2], -best[1], best[3])


class Lexicon:
    """Frequent words, and what was found of the other forms that a page asks for. While `asked` is a set, forms are only noted there."""

    def __init__(self, frequent: dict[str, float]):
        self.frequent = frequent
        self.others: dict[str, Found] = {}
        self.parts: dict[str, float] = {}
        self.asked: set[str] | None = None

    def learn(self, forms: Iterable[tuple[str, Found]]) -> None:
        self.others = dict(forms)
        self.parts = {f: x.part for f, x in self.others.items()} | {x.word: x.word_part for x in self.others.values()}

    def part(self, word: str) -> float:
        """A word's part of all words of the documents."""
        of = self.frequent.get(word)
        if of is not None:
            return of
        if self.asked is not None:
            self.asked.add(word)
        return self.parts.get(word, 0.0)

    def often(self, word: str) -> bool:
        return word in self.frequent

    def cost(self, word: str) -> float:
        return -math.log(self.part(word) + LEAST / RATIO)

    def reading(self, word: str) -> tuple[str, tuple[int, ...]]:
        """(most likely word, places misread); the word itself, without places, if it is a word or nothing better is known."""
        if word in self.frequent:
            return word, ()
        if self.asked is not None:
            self.asked.add(word)
        x = self.others.get(word)
        return (x.word, x.places) if x else (word, ())

    def segment(self, word: str) -> tuple[float, list[str]]:
        """(cost, words): the least-cost split of a form of six letters or more into two or more frequent words; an infinite cost if there is none."""
        n = len(word)
        if n < 6:
            return math.inf, [word]
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        for j in range(2, n + 1):
            for i in range(j - 1):
                if best[i][0] < math.inf and (i or j < n) and word[i:j] in self.frequent:
                    best[j] = min(best[j], (best[i][0] + self.cost(word[i:j]) + JOINED, i))
        if best[n][0] == math.inf:
            return math.inf, [word]
        out, j = [], n
        while j:
            out.append(word[best[j][1] : j])
            j = best[j][1]
        return best[n][0], out[::-1]


def like(model: str, word: str) -> str:
    """`word` in the case of `model`."""
    if model.isupper() and len(model) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() or (not model[:1].isalpha() and model[1:2].isupper()) else word


def read_token(lex: Lexicon, token: str) -> tuple[str, tuple[int, ...]]:
    """(repaired token, places misread) of one white-space token; unknown forms stay as they are."""
    core = token.strip(_EDGE)
    if not core:
        return token, ()
    if _CJK.search(token):  # such text has no spaces: its runs of other writing are tokens of their own
        out, all_places, at = [], [], 0
        for run in _LATIN_RUN.finditer(token):
            whole, places = read_token(lex, run.group())
            out += [token[at : run.start()], whole]
            all_places += [run.start() + x for x in places]
            at = run.end()
        return "".join(out) + token[at:], tuple(all_places)
    start = token.find(core)
    tail = token[start + len(core) :]
    if _NUMBER.fullmatch(core) or core.isdigit():
        return token, ()
    if lex.often(core.lower()):
        return token, ()
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    if m := _CODE.fullmatch(core):
        return token, ()
    if digits and "-" in core and letters:
        head, _, rest = core.rpartition("-")
        folded = rest.translate(AS_DIGITS)
        fixed, places = lex.reading(head.lower())
        if head and folded.isdigit() and fixed.isalpha() and len(fixed) <= 4 and lex.often(fixed) and (rest != folded or places or head != head.upper()):
            return token[:start] + fixed.upper() + "-" + folded + tail, (start + (places[0] if places else len(head) + 1),)
    if digits and digits >= letters:
        folded = core.translate(AS_DIGITS).replace("<", ",")
        if folded != core and _NUMBER.fullmatch(folded):
            at = next(i for i, (a, b) in enumerate(zip(core, folded, strict=True)) if a != b)
            return token[:start] + folded + tail, (start + at,)
        return token, ()
    # brackets and marks may be misread letters themselves
    for form, at in ((core, start), *([(token[start - 1] + core, start - 1)] if start and token[start - 1] in CONFUSIONS else ()), *([(core + tail[0], start)] if tail and tail[0] in CONFUSIONS else ())):
        low = form.lower()
        fixed, places = lex.reading(low)
        if not places and (lex.often(low) or (form is core and lex.part(low))):
            return token, ()
        if places:
            return token[:at] + like(form, fixed) + token[at + len(form) :], tuple(at + x for x in places)
    if "-" in core:
        parts = core.split("-")
        fixed = [lex.reading(p.lower()) if len(p) > 2 else (p, ()) for p in parts]
        if all(lex.part(f) >= LEAST for f, _ in fixed) and any(x for _, x in fixed):
            k = next(i for i, (_, s) in enumerate(fixed) if s)
            place = start + sum(len(p) + 1 for p in parts[:k]) + fixed[k][1][0]
            return token[:start] + "-".join(like(p, f) if s else p for p, (f, s) in zip(parts, fixed, strict=True)) + tail, (place,)
    return token, ()


def divided(lex: Lexicon, left: str, right: str) -> tuple[str, str, tuple[int, ...]] | None:
    """A word broken at a line's end: (the repaired token, its word, the places misread in left + right), or None if `left`'s mark belongs to the text.

    left ends with a mark of HYPHENS; right is the first token of the next body line.
    """
    mark, a = left[-1], left[:-1].lstrip(_EDGE)
    b = right.rstrip(_EDGE + "-")
    if not a or not b or not (a[-1].isalpha() or a[-1] in CONFUSIONS) or not (b[0].isalpha() or b[0] in "150!("):
        return None
    if sum(c.isalpha() for c in a + b) < 3 or (a.isupper() and b[0].isdigit()):
        return None
    joined, compound = (a + b).lower(), f"{a}-{b}".lower()
    whole, places = lex.reading(joined)
    if mark == "-":
        own, _ = lex.reading(compound)
        seen, apart = lex.part(whole), lex.part(own)
        if apart > seen:
            return None
        if not seen and (b[0].isupper() != a[-1].isupper() or (lex.often(a.lower()) and lex.often(b.lower()))):
            return None
    text = like(a, whole) if lex.part(whole) else a + b
    return left[: left.find(a)] + text + right[len(b) :], whole, places


_LABEL = re.compile(r"[\W_]*(?:(page|pg|p)[.\s]*)?([0-9OolI|]{1,4}|[ivxlc]{1,8})(?:\s*(?:of|/)\s*([0-9OolI|]{1,4}))?[\W_]*", re.IGNORECASE)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def page_label(line: str) -> tuple[str, int] | None:
    """(format, number) of a line that is nothing but a page's number or label. Format '0' is a bare number, 'r' a bare roman one."""
    line = line.strip()
    m = _LABEL.fullmatch(line) if len(line) <= 16 else None
    if not m or "|" in line[:1]:
        return None
    word, number, last = m.groups()
    if number in ("l", "I", "|") and not word and not last:
        number = "1"  # alone, a stroke is a one
    folded = number.translate(AS_DIGITS)
    if any(c.isdigit() for c in number) and folded.isdigit():
        value, kind = int(folded), "0"
    elif re.fullmatch(r"[ivxlc]+", number.lower()) and number == number.lower():
        values = [_ROMAN[c] for c in number]
        value, kind = sum(-v if any(w > v for w in values[i + 1 :]) else v for i, v in enumerate(values)), "r"
    else:
        return None
    frame = (word or "").lower() + ("/" if last else "") + re.sub(r"[\s\w]", "", line)[:3]
    if re.search(r"[$€£%#+=<>&@]", line) or (line[-1] in ".,;:" and not word):
        return None
    return (frame or kind), value


_FOLD_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ti", "h"), ("li", "h"))
_FOLD_PAIR = dict(_FOLD_PAIRS)
_FOLDED = re.compile("|".join(_FOLD_PAIR))
_FOLD = str.maketrans("c(f7il1!|uàä0589b", "eettlllllnaaosbgh")


_NO_END = ".,;:。" + HYPHENS


def line_key(line: str) -> str:
    """Equal for one running line on several pages: page numbers at its ends left out, usual confusions folded. Empty if the line can't be a running one."""
    line = line.strip()
    if " | " in line:
        before, _, label = line.rpartition(" | ")
        if before and page_label(label):
            line = before.strip()
    if not line or line[-1] in _NO_END or "|" in line or line.startswith(("#", "- ", "* ")):
        return ""
    words = line.split()
    while words and _is_number(words[-1]):
        words.pop()
    while words and _is_number(words[0]):
        words.pop(0)
    text = " ".join(words)
    return folded(text) if len(text) >= 4 and sum(map(str.isalpha, text)) >= 4 else ""


def _is_number(word: str) -> bool:
    """Whether a word at a line's end is a page's number or stands beside one."""
    if len(word) > 4 and word.isalpha():
        return False
    return word.strip("[]()-—–.|/").translate(AS_DIGITS).isdigit() or word.lower().strip(".") in ("page", "pg", "p", "of")


def folded(text: str) -> str:
    """Equal for texts that differ in case and usual confusions."""
    return _FOLDED.sub(lambda m: _FOLD_PAIR[m.group()], text.lower()).translate(_FOLD)


def line_shape(line: str) -> str:
    """The make of a line, without its particular words: their number, case classes, and the last word."""
    before, bar, label = line.rpartition(" | ")
    words = (before if bar and page_label(label) else line).split()[:9]
    if not words:
        return ""
    make = []
    for w in words[:-1]:
        if re.fullmatch(r"[A-Z0-9]{2,4}-\w+", w):
            make.append("C")
        elif not any(c.isalpha() for c in w):
            make.append("0" if any(c.isdigit() for c in w) else w[0])
        else:
            make.append("U" if w.isupper() and len(w) > 1 else "X" if w[0].isupper() else "w")
    make = [m for i, m in enumerate(make) if not (i and m == make[i - 1])]
    last = words[-1].lower()
    for pair, one in _FOLD_PAIRS:
        last = last.replace(pair, one)
    return f"{len(words)} {' '.join(make)} {last.translate(_FOLD)}"


def paragraphs(lines: list[str]) -> list[list[int]]:
    """Line numbers by paragraph, boundaries chosen by dynamic programming: the least sum of the costs of joining or parting neighbours and of each paragraph's own make."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    if not at:
        return []
    widths = sorted(len(lines[i].rstrip()) for i in at)
    wide = widths[int(len(widths) * 0.8)] or 1
    part_cost = []  # of a boundary before at[k], less that of none
    for k in range(1, len(at)):
        a, b = lines[at[k - 1]].rstrip(), lines[at[k]].strip()
        cost = 1.0
        ends = a[-1:] in ".。!?！？:"
        if at[k] - at[k - 1] > 1:
            cost -= 3.0 if ends or b[:1].isupper() or not b[:1].isalpha() else 0.2
        cost -= 1.5 if ends and len(a) < 0.75 * wide else 0.0
        rows = a.lstrip().startswith("|"), b.startswith("|")
        if all(rows) and at[k] - at[k - 1] == 1:  # rows of one table
            part_cost.append(6.0)
            continue
        cost -= 4.0 if any(rows) or a.lstrip().startswith("#") or b.startswith("#") else 0.0
        cost -= 4.0 if re.match(r"(\d{1,3}[.)]|[-*•])\s", b) else 0.0
        cost -= 2.5 if len(a) < 0.55 * wide and not ends and a[-1:] not in HYPHENS + "," else 0.0
        cost += 2.5 if b[:1].islower() else 0.0
        cost += 4.0 if a[-1:] in HYPHENS else 0.0
        part_cost.append(cost)
    # best[j]: least cost of the first j lines; the best start of a paragraph of two lines or more is kept as j grows
    best: list[tuple[float, int]] = [(0.0, 0)]
    open_ = (math.inf, 0)
    for j in range(1, len(at) + 1):
        start = best[j - 1][0] + (part_cost[j - 2] if j > 1 else 0.0)
        alone = (start + (0.3 if len(lines[at[j - 1]]) > 0.9 * wide else 0.0), j - 1)
        best.append(min(open_, alone))
        open_ = min(open_, (start, j - 1))
    out, j = [], len(at)
    while j:
        i = best[j][1]
        out.append(at[i:j])
        j = i
    return out[::-1]


def wordlike(token: str) -> bool:
    """Whether a token can be a part of a word, or several: letters, or more letters than digits."""
    return token.isalpha() or (token.isalnum() and 2 * sum(c.isalpha() for c in token) > len(token))


class Token(NamedTuple):
    """A token's own best reading: its text, the places misread, its cost, and whether its neighbours may change it."""

    text: str
    places: tuple[int, ...]
    cost: float
    open: bool


class Edge(NamedTuple):
    """One or two tokens of the stream as one piece of text. `places`: (0 or 1 for the token, place misread)."""

    text: str
    hyphen: bool
    misread: tuple[bool, bool]


class Reader:
    """Noise and repaired text of a stream of tokens without lines: the cheapest path over tokens read as they are, misread, run together, parted, or broken by a hyphen."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.tokens: dict[str, Token] = {}
        self.settled: set[str] = set()  # tokens that stand as they are, whatever is beside them
        self.forms: dict[str, frozenset[str]] = {}  # by token, what must be looked up for it
        self.plain: set[str] = set()  # tokens for which nothing is

    def token(self, t: str) -> Token:
        """All forms of t must have been learnt."""
        if t not in self.tokens:
            if len(self.tokens) > 500_000:  # the worker's memory; what is left out is read again
                self.tokens.clear()
                self.settled.clear()
            x = self.tokens[t] = self._token(t)
            if not x.open and x.text == t and t[-1] not in HYPHENS:
                self.settled.add(t)
        return self.tokens[t]

    def _token(self, t: str) -> Token:
        text, places = read_token(self.lex, t)
        low = text.strip(_EDGE).lower()
        cost = self.lex.cost(low)
        if places:
            return Token(text, places, cost + MISREAD + FURTHER * (len(places) - 1), False)
        if not wordlike(text) or self.lex.part(low) or _CJK.search(text):
            return Token(text, (), cost, False)
        split, words = self.lex.segment(low)
        return Token(like(text, " ".join(words)), (), split, True) if split < cost else Token(text, (), cost, True)

    def asks(self, stream: Sequence[str], ends: Sequence[int]) -> set[str]:
        """The forms, but frequent words, that `decode` will look up."""
        out: set[str] = set()
        for t in set(stream) - self.plain:
            if t not in self.forms:
                self._ask(t)
            out.update(self.forms.get(t, ()))
        if out:
            at = [k for k, t in enumerate(stream) if t in self.forms and wordlike(t)]
            for k in at:
                if k + 1 < len(stream) and (b := stream[k + 1]) in self.forms and b[0].isalnum() and not b[0].isupper():
                    out.add((stream[k] + b.rstrip(_EDGE)).lower())
        for k in ends:
            if stream[k][-1] in HYPHENS and k + 1 < len(stream):
                out |= self.asks_divided(stream[k], stream[k + 1])
        return out

    def _ask(self, t: str) -> None:
        lex = self.lex
        lex.asked = set()
        read_token(lex, t)
        if (lex.asked or wordlike(t)) and not _CJK.search(t):
            lex.asked.add(t.strip(_EDGE).lower())
        asked, lex.asked = {x for x in lex.asked if x not in lex.frequent}, None
        if len(self.forms) + len(self.plain) > 1_000_000:  # the worker's memory; what is left out is read again
            self.forms.clear()
            self.plain.clear()
        if asked:
            self.forms[t] = frozenset(asked)
        else:
            self.plain.add(t)

    def asks_divided(self, left: str, right: str) -> set[str]:
        if len(left) < 2:
            return set()
        self.lex.asked = set()
        self.lex.part(right.strip(_EDGE).lower())
        divided(self.lex, left, right)
        out, self.lex.asked = {x for x in self.lex.asked if x not in self.lex.frequent}, None
        return out

    def _pair(self, a: str, b: str, at_end: bool) -> tuple[float, Edge] | None:
        """Tokens a and b as one word, if they can be."""
        lex = self.lex
        if at_end and a[-1] in HYPHENS and len(a) > 1:
            if cut := divided(lex, a, b):
                text, word, places = cut
                lead = len(a[:-1].lstrip(_EDGE))
                cost = lex.cost(word) + (MISREAD + FURTHER * (len(places) - 1) if places else 0.0)
                return cost, Edge(text, True, (any(x < lead for x in places), any(x >= lead for x in places)))
            if a[-1] == "-" and a[-2].isalpha() and b[:1].isalnum():  # a compound parted at its own hyphen
                return lex.cost((a + b.rstrip(_EDGE)).strip(_EDGE).lower()), Edge(a + b, False, (False, False))
            return None
        if not wordlike(a) or not b[:1].isalnum() or b[:1].isupper() or not (self.token(a).open or self.token(b).open):
            return None
        core = b.rstrip(_EDGE)
        joined = (a + core).lower()
        if lex.often(joined):
            return lex.cost(joined) + JOINED, Edge(a + b, False, (False, False))
        word, places = lex.reading(joined)
        if places and lex.often(word) and self.token(a).open and self.token(b).open:
            cost = lex.cost(word) + JOINED + MISREAD + FURTHER * (len(places) - 1)
            return cost, Edge(like(a, word) + b[len(core) :], False, (any(x < len(a) for x in places), any(x >= len(a) for x in places)))
        return None

    def decode(self, stream: Sequence[str], ends: Sequence[int], following: str = "") -> list[tuple[int, int, Edge]]:
        """[(first token, number of tokens, edge)] of the cheapest path through the stream, without the edges that leave one token as it is. `ends`: tokens that close a line.

        `following`, the next page's first token, may be the rest of the last token's word: then the last edge takes it in.
        Between tokens that nothing beside them can change the path is given; dynamic programming decides the runs of others.
        """
        out: list[tuple[int, int, Edge]] = []
        n, settled, closing = len(stream), self.settled, set(ends)
        tokens = [*stream, following] if following else stream
        for t in set(stream) - settled:
            self.token(t)
        start, stop = 0, 0
        # a run: tokens that aren't settled, and one settled token on either side
        for k in [x for x, t in enumerate(stream) if t not in settled]:
            if k > stop and stop:
                out += self._run(stream, tokens, closing, start, stop)
            if k > stop or not stop:
                start = max(k - 1, stop)
            stop = min(k + 2, n)
        return out + self._run(stream, tokens, closing, start, stop) if stop else out

    def _run(self, stream: Sequence[str], tokens: Sequence[str], closing: set[int], start: int, stop: int) -> list[tuple[int, int, Edge]]:
        size, n = stop - start, len(stream)
        best: list[tuple[float, int, Edge | None]] = [(0.0, start, None)] + [(math.inf, start, None)] * (size + 1)
        for i in range(start, stop):
            t, raw, base, last = self.token(stream[i]), stream[i], best[i - start][0], i + 1 == n
            alone = base + t.cost
            if raw[-1] in HYPHENS and i in closing:
                alone += MISREAD * (1 if raw[-1] == "-" else 3)
            if alone < best[i - start + 1][0]:
                best[i - start + 1] = (alone, i, Edge(t.text, False, (bool(t.places), False)))
            if i + 1 < (len(tokens) if last else stop) and (pair := self._pair(raw, tokens[i + 1], i in closing)):
                cost = base + pair[0]
                if cost < best[i - start + 2][0] and (not last or pair[1].hyphen):
                    best[i - start + 2] = (cost, i, pair[1])
        end = stop
        if stop == n and len(tokens) > n and best[size + 1][0] < best[size][0] + self.lex.cost(tokens[n].strip(_EDGE).lower()):
            end = n + 1  # what stands alone at the end leaves the next page's token to itself
        path = []
        while end > start:
            _, i, edge = best[end - start]
            if end - i > 1 or edge.text != stream[i] or edge.misread[0]:
                path.append((i, end - i, edge))
            end = i
        return path[::-1]

    def read(self, lines: list[str], body: list[int], following: str = "") -> tuple[set[tuple[int, str]], list[str], bool]:
        """({(line index, noise)}, body lines repaired - a broken word stands whole in its first line -, whether the last line's word goes on in `following`)."""
        rows = [lines[i].split() for i in body]
        stream, ends = flat(rows)
        noise: set[tuple[int, str]] = set()
        glued = False
        edges = self.decode(stream, ends, following)
        if edges:
            at = [k for k, row in enumerate(rows) for _ in row]
            firsts = [0] + [e + 1 for e in ends]
        for k, size, edge in edges:
            line = at[k]
            rows[line][k - firsts[line]] = edge.text
            if edge.hyphen:
                noise.add((body[line], "hyphen"))
                glued = k + 1 == len(stream)
            if edge.misread[0]:
                noise.add((body[line], "misread"))
            if size > 1 and k + 1 < len(stream):
                rest = at[k + 1]
                rows[rest][k + 1 - firsts[rest]] = ""
                if edge.misread[1]:
                    noise.add((body[rest], "misread"))
        return noise, [" ".join(filter(None, r)) for r in rows], glued


def flat(rows: list[list[str]]) -> tuple[list[str], list[int]]:
    """(the rows' tokens as one stream, the tokens that close a row); rows have tokens."""
    stream: list[str] = []
    ends: list[int] = []
    for row in rows:
        stream += row
        ends.append(len(stream) - 1)
    return stream, ends


def join_lines(parts: Iterable[str]) -> str:
    """Lines as one text: a space between them, but none between characters of a script without spaces."""
    out = ""
    for p in parts:
        out += p if not out or (_CJK.match(out[-1]) and _CJK.match(p[:1] or " ")) else " " + p
    return out


def count_words(texts: Iterable[str]) -> Counter:
    counts: Counter = Counter()
    for t in texts:
        counts.update(WORD.findall(t))
    folded: Counter = Counter()
    for w, n in counts.items():
        folded[w.lower()] += n
    return folded
