"""An employer name as typed, taken apart: brand words, line of business, legal form."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Legal forms by their letters.
LEGAL = {
    "gmbh": "gmbh", "mbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "se": "se", "ug": "ug", "inc": "inc", "incorporated": "inc", "ltd": "ltd", "limited": "ltd", "bv": "bv", "sas": "sas",
    "kg": "kg", "kgaa": "kgaa", "ohg": "ohg", "ev": "ev", "eg": "eg", "llc": "llc", "llp": "llp", "plc": "plc", "corp": "corp", "corporation": "corp", "nv": "nv", "sa": "sa", "sarl": "sarl", "srl": "srl", "spa": "spa", "sl": "sl", "ab": "ab", "oy": "oy", "as": "as", "aps": "aps",
}
# Lines of business with the words that name them in English and German.
LINES = {
    "analytics": "analytik", "banking": "bank banken", "consulting": "beratung consult", "education": "bildung", "energy": "energie", "engineering": "technik ingenieure", "foods": "lebensmittel food", "games": "spiele gaming", "insurance": "versicherung versicherungen", "logistics": "logistik",
    "media": "medien", "mobility": "mobilitat", "optics": "optik optical", "pharma": "pharmaceuticals pharmazie pharmaceutical", "robotics": "robotik", "security": "sicherheit", "software": "sw", "telecom": "telekommunikation telco telekom telecommunications", "textiles": "textilien textil textile", "travel": "reisen",
}
#: Additions that tell nothing about which employer it is, behind a name; LEADING ones before it, too.
ADDED = frozenset("holding group gruppe deutschland germany careers career karriere jobs job international europe team the the haftungsbeschrankt und and co company cie".split())
LEADING = frozenset("the und and".split())
#: Texts that stand for a missing name.
PLACEHOLDERS = frozenset("confidential vertraulich na n/a none null unknown unbekannt anonymous anonym tbd test company firma employer arbeitgeber ka keineangabe keineangaben notspecified undisclosed private privat stealth xxx".split())

LINE_WORDS = {w: line for line, words in LINES.items() for w in (line, *words.split())}
_UMLAUT = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae"})
_PIECE = re.compile(r"(?:[^\W\d_]\.){2,}[^\W\d_]?\b\.?|[^\W_]+\.?")
_CAMEL = re.compile(r"(?<=[a-zäöüß]{3})(?=[A-ZÄÖÜ][a-zäöüß])")


class Name(NamedTuple):
    """``words``: brand words in their order, a trailing full stop kept; ``line`` and ``legal`` are empty if not given."""

    words: tuple[str, ...]
    line: str
    legal: str


def folded(word: str) -> str:
    """Lower case, accents dropped, ae/oe/ue as the letter they stand for."""
    low = "".join(c for c in unicodedata.normalize("NFKD", word.casefold().translate(_UMLAUT)) if not unicodedata.combining(c))
    return re.sub(r"([aou])e", r"\1", low)


def _short_line(word: str, abbreviated: bool) -> str:
    """The line a word or an abbreviation names: a beginning, or letters in order from the same first letter; the shortest line that fits."""
    if not abbreviated or len(word) < 2:
        return LINE_WORDS.get(word, "")
    begins = sorted({line for w, line in LINE_WORDS.items() if w.startswith(word)})
    if len(begins) == 1:
        return begins[0]

    def inside(w: str) -> bool:
        it = iter(w)
        return word[0] == w[0] and all(c in it for c in word)

    fits = [line for line in LINES if inside(line)]
    pool = [x for x in begins if x in fits] or fits
    return min(pool, key=lambda line: (not line.startswith(word), len(line)), default="")


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    short, long = sorted((a, b), key=len)
    return short[i:] == long[i + 1 :]


_FOLDED_LINES = {folded(w): line for w, line in LINE_WORDS.items()}
LINE_WORDS = _FOLDED_LINES | LINE_WORDS


def _pieces(name: str | None) -> list[tuple[str, bool]]:
    """Folded words of a name, and whether a full stop follows; none for null, blank, placeholders and names without letters."""
    if not name or not name.strip():
        return []
    text = unicodedata.normalize("NFC", name).strip()
    plain = re.sub(r"[\W_]+", "", text.casefold())
    if not plain or plain in PLACEHOLDERS or text.casefold() in PLACEHOLDERS:
        return []
    text = re.split(r"\s[|–—]\s|\s-\s", text)[0] or text
    pieces = []
    for raw in _PIECE.findall(_CAMEL.sub(" ", text.replace("&", " ").replace("+", " "))):
        dotted = raw.count(".") > 1
        pieces.append((folded(raw.replace(".", "")), raw.endswith(".") and not dotted))
    return pieces


def brand_and_rest(name: str | None) -> tuple[list[str], str]:
    """The words of a name that are neither legal forms nor additions, and the last of them if it is written out; what ``own`` lines are counted from."""
    words = [(w, stop) for w, stop in _pieces(name) if len(w) > 1 and w not in LEGAL and w not in ADDED]
    return [w for w, _ in words], words[-1][0] if len(words) > 1 and not words[-1][1] else ""


def parse(name: str | None, own: dict[str, str] | None = None) -> Name | None:
    """The parts of a name; None for null, blank, placeholders and names without letters. ``own``: words found to name a line, with the line."""
    pieces = _pieces(name)
    own = own or {}
    legal, line, words = "", "", []
    spare: list[str] = []
    i = 0
    while i < len(pieces):
        word, stop = pieces[i]
        last = i == len(pieces) - 1
        run = "".join(w for w, _ in pieces[i : i + 4] if len(w) == 1)
        if word in LEGAL and (words or line):
            legal = "gmbhkg" if legal == "gmbh" and LEGAL[word] == "kg" else legal or LEGAL[word]
        elif len(word) == 1 and (words or line) and (full := next((x for x in sorted(LEGAL, key=len, reverse=True) if len(x) > 1 and run.startswith(x)), "")):
            legal = legal or LEGAL[full]
            i += len(full) - 1
        elif word in ADDED and (words or line or (word in LEADING and not last)):
            spare.append(word)
        elif len(word) > 1 and (found := _short_line(word, stop and len(word) < 8)) and found == (line or found):
            line = found
        else:
            words.append(word + ("." if stop and (len(word) == 1) else ""))
        i += 1
    if not line and len(words) > 1:  # a line with a typing error
        for k, word in enumerate(words):
            if len(word) > 5 and (found := {x for w, x in LINE_WORDS.items() if len(w) > 5 and near(word, w)}):
                line = found.pop()
                del words[k]
                break
    if not line and len(words) > 1 and own:
        at = [k for k, w in enumerate(words) if w in own]
        typed = [(k, own[w]) for k in range(1, len(words)) if len(words[k]) > 5 for w in sorted(own) if len(w) > 5 and near(words[k], w)] if not at else []
        if at or len({x for _, x in typed}) == 1:
            k = at[-1] if at else typed[0][0]
            line = own[words[k]] if at else typed[0][1]
            del words[k]
    if not line and len(words) == 1:  # a line written together with the brand
        word = words[0]
        for w, found in LINE_WORDS.items():
            rest = word[len(w) :] if word.startswith(w) else word[: -len(w)] if word.endswith(w) else ""
            if len(w) > 4 and len(rest) > 4:
                line, words = found, [rest]
                break
    if not words:
        words = [x for x in (line, *spare) if x]
        line = ""
    return Name(tuple(words), line, legal) if words else None
