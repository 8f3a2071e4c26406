"""Free-entered values to the entries of a canonical list.

Names and other names of the entries (and country codes, where written in capitals) form a multi-pattern automaton
that runs over the folded words of a value and finds every embedded mention. Where the words are spelled
differently, runs of words are compared with the names by token-set similarity: a word equals a name's word if it
is one edit away (insertion, deletion, substitution or swap) or a prefix that ends in a full stop; so does a run of
words that is one edit away from a whole name, or a prefix of it that ends in a full stop. Of all mentions the
longest that do not overlap win, exact before similar. Mentions of several entries of one name are settled by a
country mentioned along with it. A country, or a region, does not count beside one of its cities.

Defined results: null and blank values have no row. A value that names no entry gives the entry id 0. A mention
that stays ambiguous counts for every entry of that name only if none of them can be told apart by country; a
similar mention that fits several names equally well counts for none. Which words only surround names is counted in the
values: a word outside all mentions that stands beside AROUND_ENTRIES different entries or more; a short list of common ones
is added. A region drops out beside a city only where ``regions`` says that the city's country belongs to it. Repeated rows of a key count once (the
latest; ties: the greatest value). Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimfold.llm.text import once_per_worker
from brimfold.plans.shared import bounded_rows

MAX_PLACES = 200_000
#: A word beside so many different entries names none of them. More than MAX_AROUND such words are refused.
AROUND_ENTRIES, MAX_AROUND = 8, 100_000
CACHE = 100_000
#: Words around a place that are no part of its name, where the values are too few to count them.
AROUND = frozenset(
    "remote hybrid onsite on site office area near bei raum greater metro region grossraum umgebung city mitte nord sued sud ost west zentrum innenstadt altstadt north south east central downtown "
    "only based nur und and or oder in the from von within anywhere home homeoffice deutschlandweit worldwide-remote fully full time possible moeglich moglich".split()
)
#: The countries of the regions that lists of places name; the default of ``regions``. WORLD has all.
WORLD = "*"
EUROPE = "AL AT BA BE BG BY CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MD ME MK MT NL NO PL PT RO RS SE SI SK UA".split()
REGIONS = {
    "europe": EUROPE,
    "europe, middle east and africa": [*EUROPE, *"AE BH EG ET GH IL IQ IR JO KE KW LB MA NG OM QA RW SA SN TN TR TZ UG ZA".split()],
    "north america": "CA MX US".split(),
    "latin america": "AR BO BR CL CO CR CU DO EC GT HN MX NI PA PE PY SV UY VE".split(),
    "asia pacific": "AU BD CN HK ID IN JP KH KR LK MM MY NP NZ PH PK SG TH TW VN".split(),
    "worldwide": [WORLD],
}

LIST_SIGNS, LIST_WORDS = frozenset("|;/\n"), frozenset("und or oder and".split())
_TOKEN = re.compile(r"[^\W_]+\.?")
_CUT = re.compile(r"[\s\-]+\.(?![^\W_])")
_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
_GERMAN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ø": "oe", "å": "aa"})


def _mojibake() -> tuple[re.Pattern, dict[str, str]]:
    """UTF-8 read as a one-byte code page, for the letters beyond ASCII, whatever happened to its case."""
    table = {}
    for code in range(0xA1, 0x180):
        raw = chr(code).encode()
        for page in ("cp1252", "latin-1"):
            try:
                wrong = raw.decode(page)
            except UnicodeDecodeError:
                continue
            for x in (wrong, wrong.lower(), wrong.upper(), wrong.swapcase()):
                if len(x) == 2 and x[0] in "ÂâÃãÄäÅå":
                    table.setdefault(x, chr(code))
    return re.compile("|".join(map(re.escape, table))), table


def fold(text: str) -> str:
    """Lower case without accents."""
    low = text.casefold().translate(_SPECIAL)
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


class Entry(NamedTuple):
    id: int
    name: str
    kind: str
    country: str | None
    others: tuple[str, ...]


class Mention(NamedTuple):
    first: int
    last: int
    exact: bool
    ids: tuple[int, ...]


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    short, long = sorted((a, b), key=len)
    return short[i:] == long[i + 1 :]


def _deletions(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Places:
    """The compiled list; built once per worker. ``around``: words that only surround names; ``regions``: folded name of a region -> country codes."""

    def __init__(self, entries: list[Entry], around: frozenset[str] = AROUND, regions: dict[str, list[str]] = REGIONS):
        self.entries, self.around, self.regions = {e.id: e for e in entries}, around, regions
        self.broken, self.repair = _mojibake()
        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, set[int]] = defaultdict(set)
        self.codes = {e.country: e.id for e in entries if e.kind == "country" and e.country}
        for e in entries:
            for name in (e.name, *e.others):
                for form in {fold(name), fold(name.casefold().translate(_GERMAN))}:
                    patterns[" ".join(w.rstrip(".") for w in _TOKEN.findall(form))].add(e.id)
        patterns.pop("", None)
        self.words = {w for name in patterns for w in name.split(" ")}
        self.whole: dict[str, set[int]] = defaultdict(set)  # a name in one piece, less a letter -> names
        self.starts: dict[str, set[int]] = defaultdict(set)  # its beginnings -> entries
        self.spelled: dict[str, set[int]] = defaultdict(set)  # the same with accents and spaces
        for e in entries:
            for name in (e.name, *e.others):
                line = " ".join(w.rstrip(".") for w in _TOKEN.findall(name.casefold()))
                for k in range(3, len(line)):
                    self.spelled[line[:k]].add(e.id)
        self.names: list[tuple[list[str], tuple[int, ...]]] = []
        self.by_deletion: dict[str, set[int]] = defaultdict(set)  # word less a letter -> names
        self.by_prefix: dict[str, set[int]] = defaultdict(set)
        for name, ids in patterns.items():
            self.automaton.add_word(f" {name} ", (len(name.split(" ")), tuple(sorted(ids))))
            for w in name.split(" "):
                for d in _deletions(w):
                    self.by_deletion[d].add(len(self.names))
                for k in range(1, len(w)):
                    self.by_prefix[w[:k]].add(len(self.names))
            piece = name.replace(" ", "")
            for d in _deletions(piece) if len(piece) >= 4 else ():
                self.whole[d].add(len(self.names))
            for k in range(3, len(piece)):
                self.starts[piece[:k]].update(ids)
            self.names.append((name.split(" "), tuple(sorted(ids))))
        self.automaton.make_automaton()
        self.longest = max((len(n) for n, _ in self.names), default=0)

    @staticmethod
    def _same(word: str, name: str) -> float:
        """How well a word of a value stands for a word of a name, 0 to 1."""
        if word.endswith("."):
            w = word[:-1]
            return 0.9 if name.startswith(w) and len(w) < len(name) else 0.0 if len(w) < 4 else 0.8 * near(w, name)
        if word == name:
            return 1.0
        return 0.8 if len(word) >= 4 and len(name) >= 4 and near(word, name) else 0.0

    def _in_one_piece(self, run: list[str], raw: list[str]) -> set[int]:
        """Entries with a name that the run is one edit from, or that begins with a run that ends in a full stop."""
        piece = "".join(w.rstrip(".") for w in run)
        ids: set[int] = set()
        if len(piece) >= 4:
            for k in set().union(*(self.whole.get(d, ()) for d in _deletions(piece))):
                name, owners = self.names[k]
                if near(piece, "".join(name)):
                    ids.update(owners)
        if not ids and run[-1].endswith("."):
            ids = self.starts.get(piece, set())
            if len(ids) > 1:  # an accent or a space may tell them apart
                ids = ids & self.spelled.get(" ".join(w.rstrip(".") for w in raw).casefold(), set()) or ids
        return ids

    def _similar(self, words: list[str], raw: list[str]) -> list[Mention]:
        """Runs of words whose token-set similarity to a name is 0.8 or more, and those that match in one piece."""
        found = []
        for first in range(len(words)):
            for last in range(first, min(len(words), first + self.longest + 1)):
                run = words[first : last + 1]
                if any(w.rstrip(".") in self.around and (len(run) == 1 or w.rstrip(".") not in self.words) for w in (run[0], run[-1])):
                    continue
                if ids := self._in_one_piece(run, raw[first : last + 1]):
                    found.append(Mention(first, last, False, tuple(sorted(ids))))
                    continue
                maybe: set[int] | None = None
                for w in run:
                    bare = w.rstrip(".")
                    hits = set().union(*(self.by_deletion.get(d, ()) for d in _deletions(bare)))
                    if w.endswith("."):
                        hits |= self.by_prefix.get(bare, set())
                    maybe = hits if maybe is None else maybe & hits
                    if not maybe:
                        break
                best, ids = 0.0, set()
                for k in maybe or ():
                    name, owners = self.names[k]
                    if len(name) != len(run):
                        continue
                    rest, total = list(name), 0.0
                    for w in run:
                        score, other = max(((self._same(w, n), n) for n in rest), default=(0.0, ""))
                        if not score:
                            break
                        total += score
                        rest.remove(other)
                    if rest:
                        continue
                    if (value := total / len(run)) > best:
                        best, ids = value, set(owners)
                    elif value == best:
                        ids |= set(owners)
                if best >= 0.8 - 1e-9:
                    found.append(Mention(first, last, False, tuple(sorted(ids))))
        return found

    def _taken_apart(self, value: str) -> tuple[list[str], list[str], list[int]]:
        """Folded words of a value, the words as written, and which item of a list each is in."""
        text = value
        for _ in range(3):  # encoded wrongly up to three times
            if not self.broken.search(text):
                break
            text = self.broken.sub(lambda m: self.repair[m[0]], text)
        text = _CUT.sub(".", text)
        text = unicodedata.normalize("NFC", text)
        spans = [m.span() for m in _TOKEN.finditer(text)]
        raw = [text[a:b] for a, b in spans]
        words = [fold(w) for w in raw]
        parts, part = [], 0
        for i, (a, _) in enumerate(spans):
            part += words[i] in LIST_WORDS or (i > 0 and not LIST_SIGNS.isdisjoint(text[spans[i - 1][1] : a]))
            parts.append(part)
        return words, raw, parts

    def _embedded(self, bare: list[str], raw: list[str]) -> list[Mention]:
        """Names that stand in the words as they are, and country codes in capitals."""
        starts, at = {}, 0
        for i, w in enumerate(bare):
            starts[at] = i
            at += len(w) + 1
        line = " " + " ".join(bare) + " "
        mentions = []
        for end, (count, ids) in self.automaton.iter(line):
            last = starts.get(line.rindex(" ", 0, end), None) if end else None
            if last is not None:
                mentions.append(Mention(last - count + 1, last, True, ids))
        for i, w in enumerate(raw):
            if len(w) == 2 and w.isupper() and w in self.codes:
                mentions.append(Mention(i, i, True, (self.codes[w],)))
        return mentions

    def beside(self, value: str) -> list[tuple[str, int]]:
        """(word, entry) for each word outside all embedded mentions and each entry of one name mentioned."""
        words, raw, _ = self._taken_apart(value)
        if not words or not self.names:
            return []
        bare = [w.rstrip(".") for w in words]
        mentions = self._embedded(bare, raw)
        covered = {i for m in mentions for i in range(m.first, m.last + 1)}
        rest = {w for i, w in enumerate(bare) if i not in covered and w and words[i] == w and not w.isdecimal()}
        return [(w, m.ids[0]) for w in rest for m in mentions]

    def like_a_name(self, word: str) -> bool:
        """Whether a word is a word of a name, or one edit from one."""
        return word in self.words or any(near(word, w) for k in set().union(*(self.by_deletion.get(d, ()) for d in _deletions(word))) for w in self.names[k][0] if len(w) >= 4)

    def find(self, value: str) -> list[int]:
        """Entry ids that a value names; empty if none."""
        words, raw, parts = self._taken_apart(value)
        if not words or not self.names:
            return []
        bare = [w.rstrip(".") for w in words]
        mentions = self._embedded(bare, raw)
        covered = {i for m in mentions for i in range(m.first, m.last + 1)}
        if any(i not in covered and w not in self.around and not w.isdecimal() for i, w in enumerate(bare)):
            mentions += self._similar(words, raw)
        taken: set[int] = set()
        chosen: list[Mention] = []
        for m in sorted(mentions, key=lambda m: (m.first - m.last, not m.exact, -sum(len(bare[i]) for i in range(m.first, m.last + 1)), m.first)):
            if taken.isdisjoint(range(m.first, m.last + 1)):
                taken.update(range(m.first, m.last + 1))
                chosen.append(m)
        return self._settle(sorted(chosen), parts)

    def _settle(self, chosen: list[Mention], parts: list[int]) -> list[int]:
        """Ambiguous names by the nearest country (of the same item of a list, if there is one; after the name rather than before), then countries and regions beside their cities dropped."""
        entries = self.entries
        countries = [(m.first, entries[i].country) for m in chosen for i in m.ids if entries[i].kind == "country"]
        result: list[int] = []
        for m in chosen:
            ids = list(m.ids)
            if len(ids) > 1:
                near_by = sorted((parts[at] != parts[m.first], abs(at - m.first), at < m.first, code) for at, code in countries if code)
                told = next(([i for i in ids if entries[i].country == code] for *_, code in near_by if any(entries[i].country == code for i in ids)), None)
                names = {entries[i].name for i in ids}
                ids = told if told and len(told) == 1 else ids if m.exact or len(names) == 1 else []
            result += ids
        homes = {entries[i].country for i in result if entries[i].kind == "city"}
        kept = []
        for i in dict.fromkeys(result):
            e = entries[i]
            if e.kind == "country" and e.country in homes:
                continue
            codes = self.regions.get(e.name.casefold(), ())
            if e.kind == "region" and homes and (WORLD in codes or not homes.isdisjoint(codes)):
                continue
            kept.append(i)
        return kept


def _compiled(kept) -> Places:
    """``kept``: a broadcast (entries, around, regions)."""
    return once_per_worker(("places", kept.value), lambda: Places(list(kept.value[0]), kept.value[1], {k: list(v) for k, v in kept.value[2]}))


def _beside(kept):
    """Iterator function: (_key, _v) to (word, entry): words outside all mentions, with the entries mentioned beside them; each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _compiled(kept)
        for batch in batches:
            found = sorted({x for value in set(batch.column(1).to_pylist()) for x in places.beside(value)})
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([i for _, i in found], pa.int32())], ["word", "entry"])

    return run


def _map(kept, skip: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, cache = _compiled(kept), {}
        for batch in batches:
            rows, ids = [], []
            for r, value in enumerate(batch.column(1).to_pylist()):
                if value not in cache:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[value] = [] if value in skip else places.find(value) or [0]
                rows += [r] * len(cache[value])
                ids += cache[value]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int32())], ["_key", "place_id"])

    return run


def place_entries(places: DataFrame) -> list[Entry]:
    """The canonical list on the driver; more than MAX_PLACES entries are refused."""
    rows = bounded_rows(places.select("place_id", "name", "kind", "country_code", "other_names").where("place_id is not null and name is not null"), MAX_PLACES, "list of places")
    return sorted(Entry(r.place_id, r.name, r.kind or "", r.country_code, tuple(x for x in r.other_names or () if x)) for r in rows)


def map_places(df: DataFrame, key: str, value: str, latest: str, entries: list[Entry], skip_exact: bool = False, around: frozenset[str] = AROUND, regions: dict[str, list[str]] = REGIONS) -> DataFrame:
    """(row_key, place_id): one row per key and entry meant; ``skip_exact`` leaves out values that are a name as it stands."""
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(value).cast("string").alias("_v"), F.col(latest).alias("_at")).where("_key is not null")
    rows = rows.groupBy("_key").agg(F.max(F.struct("_at", "_v")).alias("_m")).select("_key", F.col("_m._v").alias("_v")).where(F.col("_v").rlike(r"(?U)\S"))
    every = tuple((k.casefold(), tuple(v)) for k, v in sorted(regions.items()))
    # counted over all values as they were delivered; a word beside a hot value is one row a batch
    texts = df.select(F.col(key).cast("string").alias("_key"), F.col(value).cast("string").alias("_v")).where(F.col("_v").isNotNull())
    beside = texts.mapInArrow(_beside(sc.broadcast((tuple(entries), around, every))), "word string, entry int").distinct()
    counted = beside.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= AROUND_ENTRIES).select("word")
    plain = Places(entries, around, regions)
    found = frozenset(w for (w,) in bounded_rows(counted, MAX_AROUND, "list of words around places") if not plain.like_a_name(w))
    skip = frozenset(e.name for e in entries) if skip_exact else frozenset()
    kept = sc.broadcast((tuple(entries), around | found, every))
    return rows.mapInArrow(_map(kept, skip), "_key string, place_id int").select(F.col("_key").alias("row_key"), "place_id")
