"""Text that looks the same brought to one plain form.

Ignorable characters go, blanks and hyphens become the ordinary ones, letters, digits and ideographs
take their compatibility form and compose. What remains are look-alike letters of other scripts.
For each token that holds one, the lattice of what every character may stand for, in every script it
may stand in, is searched with Viterbi under character n-gram scores; a change of script costs more than
any n-gram, so that a path leaves its script only where it must.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: Cyrillic letters and the Latin letters they look like
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ғ": "F", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I", "ѵ": "v", "Ѵ": "V", "к": "k",
}
# fixed values: Greek letters and the Latin letters they look like
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "η": "n", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "ϵ": "e",
}
# fixed values: other letters that look like Latin ones
OTHER = {
    "Հ": "Z", "Ս": "U", "Տ": "S", "Օ": "O", "Լ": "L", "ց": "g", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ք": "f", "զ": "q", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z",
}
LOOK_ALIKES = CYRILLIC | GREEK | OTHER

# fixed values: second readings of letters that look like two Latin ones
SECOND_READINGS = {"І": "l", "Ι": "l", "Ӏ": "l", "ӏ": "I", "υ": "v", "ɩ": "l"}


def _accented() -> dict[str, str]:
    """Precomposed letters on a look-alike: the same marks on the Latin letter."""
    out = {}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        whole = unicodedata.normalize("NFD", c)
        if len(whole) > 1 and whole[0] in LOOK_ALIKES and c not in LOOK_ALIKES:
            out[c] = unicodedata.normalize("NFC", LOOK_ALIKES[whole[0]] + whole[1:])
    return out


ACCENTED = _accented()
DOUBTFUL = LOOK_ALIKES | ACCENTED

# fixed values: CJK radicals without compatibility decomposition and the ideographs they stand for
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺆": "冂", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺌": "小", "⺍": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺",
    "⺔": "彑", "⺕": "彐", "⺖": "忄", "⺗": "㣺", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬",
    "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罓",
    "⺲": "罒", "⺶": "羊", "⺸": "羋", "⺹": "耂", "⺺": "肀", "⺼": "肉", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西",
    "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "邑", "⻐": "钅", "⻑": "長", "⻒": "镸",
    "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马",
    "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙",
    "⻱": "龜", "⻲": "亀",
}
# fixed values: hyphens that look like the ordinary one
HYPHENS = "‐‑‒﹣－"
# compatibility forms that look different from the plain character and stay
DIFFERENT = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>")

ORDER = 3  # characters in an n-gram
NGRAMS = "gram string, n bigint"
_WORDS = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


def _ignorable(c: str) -> bool:
    """Default-ignorable characters: format controls, variation selectors, fillers, C0/C1 controls that are no white space."""
    o = ord(c)
    if unicodedata.category(c) == "Cf":
        return not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD))
    return 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0) or (unicodedata.category(c) == "Cc" and not c.isspace())


def _character(c: str) -> str:
    if c < "\x7f" and c >= " ":
        return c
    if _ignorable(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    if c in RADICALS:
        return RADICALS[c]
    tag = unicodedata.decomposition(c)
    if tag and not tag.startswith(DIFFERENT) and unicodedata.category(c)[0] in "LNS" and (c.isalnum() or unicodedata.name(c, "").startswith("KANGXI")):
        return unicodedata.normalize("NFKC", c)
    return c


def normalized(text: str) -> str:
    """Compatibility form of letters, digits and ideographs, composed; no invisible characters; ordinary blanks and hyphens.

    Other punctuation keeps its width; super- and subscripts, fractions and circled numbers look
    different from plain digits and stay.
    """
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", "".join(map(_character, unicodedata.normalize("NFC", text))))


def script(c: str) -> str:
    """Latin, Cyrillic, Greek or the first word of the character's name; '' for what belongs to no script."""
    if c < "\x80":
        return "LATIN" if c.isalpha() else ""
    return unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else ""


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of letters (with their marks), cut where ideographs begin or end."""
    spans = []
    for m in _WORDS.finditer(text):
        start = m.start()
        for i in range(m.start(), m.end() + 1):
            if i == m.end() or _wide(text[i]):
                if i > start:
                    spans.append((start, i))
                start = i + 1
    return spans


def _wide(c: str) -> bool:
    return c >= "⺀" and not ("ﬀ" <= c <= "ﬆ")


ALPHABET = frozenset("abcdefghijklmnopqrstuvwxyz" + "".join(LOOK_ALIKES) + "".join(LOOK_ALIKES).lower())


def modelled(text: str) -> str:
    """``text`` in the model's alphabet: lower case, with one sign for every letter outside of it."""
    return "".join(c if c in ALPHABET else "?" for c in text.lower())


def grams(token: str) -> list[str]:
    """n-grams of all orders up to ORDER that end in a character of the token or in its end."""
    padded = "^" * (ORDER - 1) + modelled(token) + "$"
    return [padded[i - k : i + 1] for i in range(ORDER - 1, len(padded)) for k in range(ORDER)]


class Model:
    """Interpolated n-gram scores: each order leans on the one below, the lowest on a small constant."""

    LEAN = 5.0

    def __init__(self, counts: Mapping[str, int]):
        self.counts = counts
        self.contexts: dict[str, int] = {}
        for g, n in counts.items():
            self.contexts[g[:-1]] = self.contexts.get(g[:-1], 0) + n

    def score(self, before: str, c: str) -> float:
        history = ("^" * (ORDER - 1) + before)[-(ORDER - 1) :]
        p = 1e-4
        for k in range(ORDER):
            context = history[len(history) - k :]
            p = (self.counts.get(context + c, 0) + self.LEAN * p) / (self.contexts.get(context, 0) + self.LEAN)
        return math.log(p)


SWITCH = 40.0  # cost of a change of script within a token
SECOND = 3.0  # cost of a second reading


def _classes() -> dict[str, dict[str, list[str]]]:
    """Latin letter -> script -> the letters of that script that look like it."""
    out: dict[str, dict[str, list[str]]] = {}
    for c, latin in DOUBTFUL.items():
        out.setdefault(latin, {}).setdefault(script(c), []).append(c)
    return out


CLASSES = _classes()


def home_scripts(token: str) -> set[str]:
    """Scripts that doubtful letters of a token may be read in.

    Latin, unless another script has a letter beyond doubt (that no Latin one looks like); then that
    script, if most letters are of it as written and no letter is Latin beyond doubt. A word mostly
    Latin stays so with one odd letter in it. Else nothing is read otherwise: the letters are symbols.
    """
    written = [script(c) for c in token if script(c)]
    sure = [script(c) for c in token if script(c) not in ("", "LATIN") and c not in DOUBTFUL]
    sure_latin = sum(1 for c in token if script(c) == "LATIN" and c not in CLASSES and c not in DOUBTFUL)
    if not sure:
        return {"LATIN"}
    if len(set(sure)) == 1 and not sure_latin and 2 * written.count(sure[0]) > len(written):
        return {sure[0]}
    return {"LATIN"} if len(sure) == 1 and sum(s == "LATIN" for s in written) >= 3 else set()


def readings(c: str, homes: set[str]) -> list[tuple[str, float]]:
    """What a letter may stand for, with its cost: itself, and its look-alikes in the home scripts."""
    out = [(c, 0.0)]
    latin = DOUBTFUL.get(c, c)
    for home in sorted(homes - {script(c)}):
        if home == "LATIN":
            out += [(latin, 0.0)] + [(x, SECOND) for x in SECOND_READINGS.get(c, "")]
        else:
            out += [(x, SECOND * i) for i, x in enumerate(CLASSES.get(latin, {}).get(home, ()))]
    return out


def viterbi(token: str, model: Model) -> str:
    """The likeliest reading of a token over the lattice of what its letters may stand for.

    A state is the script and the last letters of a path; of all paths into a state the best one goes
    on. A lone Greek letter is a symbol and stays. Ties go to Latin.
    """
    homes = home_scripts(token)
    if (len(token) == 1 and token in GREEK) or not any(len(readings(c, homes)) > 1 for c in token):
        return token
    states: dict[tuple[str, str], tuple[float, str]] = {("", "^" * (ORDER - 1)): (0.0, "")}
    for c in token:
        step: dict[tuple[str, str], tuple[float, str]] = {}
        for x, cost in readings(c, homes):
            own, shown = script(x), modelled(x)
            for (now, before), (total, text) in states.items():
                turn = SWITCH if own and now and own != now else 0.0
                state = (own or now, (before + shown)[-(ORDER - 1) :])
                score = total + model.score(before, shown[-1:] or "?") - cost - turn
                if state not in step or (score, own == "LATIN") > (step[state][0], step[state][1][-1:] < "\x80"):
                    step[state] = (score, text + x)
        states = step
    ended = {state: (total + model.score(state[1], "$"), state[0] == "LATIN", text) for state, (total, text) in states.items()}
    return max(ended.values(), key=lambda e: e[:2])[2]


def plain(text: str, model: Model) -> str:
    text = normalized(text)
    if text.isascii():
        return text
    out, at = [], 0
    for s, e in tokens(text):
        word = text[s:e]
        out += [text[at:s], word if word.isascii() else viterbi(word, model)]
        at = e
    return "".join([*out, text[at:]])


def ngram_counts(cells: DataFrame) -> DataFrame:
    """(gram, n) over the letter tokens of all cells (column ``cell``), in normalized form. Counted per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: dict[str, int] = {}
            for cell in pdf["cell"]:
                text = normalized(cell)
                for s, e in tokens(text):
                    for g in grams(text[s:e]):
                        n[g] = n.get(g, 0) + 1
            yield pd.DataFrame({"gram": list(n), "n": list(n.values())})

    return cells.mapInPandas(count, NGRAMS).groupBy("gram").agg(F.sum("n").alias("n"))


def plain_forms(cells: DataFrame) -> DataFrame:
    """Cells (row_id, field_name, cell) that differ from their plain form: (row_id, field_name, plain_text).

    Null cells and cells already plain give no row; repeated rows repeat. The model counts all
    cells. Its alphabet is fixed (Latin letters, the look-alikes, one sign for all else), so it has
    at most alphabet**ORDER n-grams whatever the number of rows, which bounds what is broadcast.
    """
    cells = cells.where("cell IS NOT NULL").select("row_id", "field_name", "cell")
    shared = cells.sparkSession.sparkContext.broadcast({r.gram: r.n for r in ngram_counts(cells).collect()})

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        for pdf in batches:
            out = [(r, f, p) for r, f, c in zip(pdf["row_id"], pdf["field_name"], pdf["cell"]) if (p := plain(c, model)) != c]
            yield pd.DataFrame(out, columns=["row_id", "field_name", "plain_text"])

    return cells.mapInPandas(rewrite, "row_id bigint, field_name string, plain_text string")
