import datetime as dt
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from brimfold.llm import queries
from brimfold.operators.components import components
from brimfold.llm.employer_names import near, parse
from brimfold.llm.employers import close_brands, employers, own_lines, spelling_pairs
from brimfold.llm import eval_leaks as leaks_module
from brimfold.llm.eval_leaks import eval_leaks
from brimfold.plans.shared import TooLarge
from brimfold.llm.mixing import filled, mix
from brimfold.llm import near_duplicates as near_module
from brimfold.llm.near_duplicates import all_pairs, classes, near_duplicates
from brimfold.llm.places import Entry, Places, map_places, place_entries
from brimfold.llm.shared_spans import shared_chars, shared_spans

FOLDER = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "io", "ull", "anz")]
CLASH = ("_id", "_text", "_h", "_pos", "_key", "_set", "_at", "node", "label", "tokens", "_source", "a", "b", "n", "rep")


def clashing(df):
    """With extra columns that have the names operators use inside."""
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})



@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, FOLDER, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_found_columns(spark):
    want = {"p1_found": ["id_a", "id_b"], "p3_found": ["feed", "row_key", "place_id"], "p5_found": ["name_a", "name_b"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "shared_chars"]}
    assert {n: queries.QUERIES[n](spark, FOLDER).columns for n in want} == want


def test_components_of_chains_and_random_edges(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100)] + [(r.randrange(500, 900), r.randrange(500, 900)) for _ in range(200)] + [(None, 3)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] and None not in e for e in edges)}


# --- 1 -------------------------------------------------------------------------------------------------------------
def shingles(text, n):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(r, words):
    words = list(words)
    for _ in range(r.randrange(6)):
        i = r.randrange(len(words))
        r.choice([lambda: words.insert(i, r.choice(WORDS)), lambda: words.pop(i), lambda: words.__setitem__(i, r.choice(WORDS))])()
    return words


def alike(sets, least=0.6):
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def class_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("groups", "most", "block"), [(40, 8, 256), (3, 60, 16)])
def test_near_duplicates_like_brute_force(spark, monkeypatch, groups, most, block):
    monkeypatch.setattr(near_module, "BLOCK_NODES", block)
    r = random.Random(groups)
    texts = []
    for _ in range(groups):
        base = [r.choice(WORDS) for _ in range(r.randrange(30, 120))]
        texts += [" ".join(edited(r, base)) for _ in range(r.randrange(1, most))]
    texts += [texts[0]] * 5 + [None, "", "two words", "<p></p>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, body string")
    found = near_duplicates(df, "id", ["body"], "body", n=3, threshold=0.6)
    got = [tuple(x) for x in all_pairs(found).collect()]
    sets = {i: s for i, t in enumerate(texts) if t and (s := shingles(t, 3))}
    want = alike(sets)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want) and len(want) > 50
    one = {x.id: x.class_id for x in classes(found).collect()}
    assert one == class_of(got, sets)


def test_members_of_a_band_that_are_unlike_its_leader(spark):
    """Two groups that share half of their words: their bands mix, and no link of either is lost."""
    r = random.Random(9)
    common = [r.choice(WORDS) for _ in range(60)]
    texts = []
    for _ in range(6):
        own = [r.choice(WORDS) + str(r.randrange(99)) for _ in range(60)]
        texts += [" ".join(common + edited(r, own)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, body string")
    found = near_duplicates(df, "id", ["body"], "body", n=3, threshold=0.6)
    sets = {i: shingles(t, 3) for i, t in enumerate(texts)}
    want = alike(sets)
    got = {tuple(x) for x in all_pairs(found).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_recall_at_the_threshold():
    """Pairs of sets of similarity 0.6, through the bands themselves."""
    r, pairs = random.Random(4), 1200
    rows = []
    for i in range(pairs):
        words = [f"w{i}x{k}" for k in range(102)]
        r.shuffle(words)
        rows += [" ".join(words[:82]), " ".join(words[20:])]  # 80 three-word sequences each, 60 of 100 in common
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * pairs)), pa.array([0] * 2 * pairs), pa.array(range(2 * pairs)), pa.array(rows)], ["_id", "_at", "_row", "_t0"])
    out = next(iter(near_module._sketches(["_t0"], "_t0", 3, 64, 5)(iter([batch]))))
    sets, bands = [set(np.frombuffer(x, np.uint32).tolist()) for x in out.column("_set").to_pylist()], out.column("_bands").to_pylist()
    assert all(len(sets[2 * i] & sets[2 * i + 1]) == 60 and len(sets[2 * i]) == 80 for i in range(pairs))
    hit = sum(any(x == y for x, y in zip(bands[2 * i], bands[2 * i + 1])) for i in range(pairs))
    assert hit / pairs > 0.985  # 0.994 expected, 0.6 ** 5 a band
    # the sketches agree as often as they should, and none of these pairs comes near the bound below which they are told apart
    bits = [np.unpackbits(np.array(x, np.int64).view(np.uint8)) for x in out.column("_sig").to_pylist()]
    agree = [int((bits[2 * i] == bits[2 * i + 1]).sum()) for i in range(pairs)]
    assert abs(np.mean(agree) / 320 - 0.8) < 0.01 and np.std(agree) < 1.3 * (320 * 0.8 * 0.2) ** 0.5 and min(agree) > 320 * 0.8 - 5 * (320 * 0.8 * 0.2) ** 0.5


def test_near_duplicate_edges(spark):
    t = "one two three four five six"
    rows = [(1, t, None, dt.datetime(2026, 1, 1)), (1, "other words here are not the same", None, dt.datetime(2025, 1, 1)), (2, t.upper() + "!", None, None), (None, t, "", None), (3, "", t, None), (4, None, None, None), (5, "w " * 200_000, None, None), (6, "w " * 200_001, None, None), (7, "<b>one</b> two&nbsp;three <i>four</i> five six", "", None)]
    df = spark.createDataFrame(rows, "k bigint, body string, head string, at timestamp").transform(clashing)
    run = lambda x: sorted(map(tuple, all_pairs(near_duplicates(x, "k", ["head", "body"], "body", "at")).collect()))
    assert run(df) == [(1, 2), (1, 7), (2, 7), (5, 6)]
    assert run(df.limit(0)) == [] and classes(near_duplicates(df.limit(0), "k", ["body"], "body")).collect() == []


# --- 3 -------------------------------------------------------------------------------------------------------------
ENTRIES = [
    Entry(1, "Mara Falls", "city", "CA", ("Lorinova",)), Entry(2, "Tulominster", "city", "AT", ()), Entry(3, "Tulominster", "city", "GB", ()), Entry(4, "Linismünde", "city", "DE", ()), Entry(5, "Trevelópolis", "city", "BR", ()),
    Entry(10, "Canada", "country", "CA", ("Kanada",)), Entry(11, "Austria", "country", "AT", ("Österreich",)), Entry(12, "United Kingdom", "country", "GB", ("UK",)), Entry(13, "Germany", "country", "DE", ("Deutschland",)), Entry(14, "United States", "country", "US", ("USA", "U.S.")),
    Entry(20, "Europe", "region", None, ("EU",)), Entry(21, "Europe, Middle East and Africa", "region", None, ("EMEA",)), Entry(22, "Worldwide", "region", None, ("Anywhere in the world",)), Entry(23, "North America", "region", None, ()),
]


@pytest.mark.parametrize(
    "value, ids",
    [
        ("MARA FALLS", [1]), ("Mara Fa. (Canada)", [1]), ("Mara .", [1]), ("bei lorinova", [1]), ("Tulominster, UK", [3]), ("AT - Tulominster", [2]), ("Linismuende,DE", [4]), ("Linismünde-Nord", [4]), ("12345 Linsimünde", [4]), ("LinismÃ¼nde / Germany", [4]), ("LinismÃ\x83Â¼nde", [4]),
        ("Treveló.", [5]), ("Deutchland (remote)", [13]), ("Remote", []), ("Hybrid", []), ("Quinagloch", []), ("", []), ("?", []), ("Europe, Middle East adn Africa", [21]), ("Europe, Middle East and Africa or Canada", [21, 10]), ("Canada / Europe", [10, 20]), ("Mara Falls; Linismünde", [1, 4]),
        ("Linismünde, Europe", [4]), ("Linismünde und Canada", [4, 10]), ("U.S. only", [14]), ("Anywhere n the world", [22]), ("North merica", [23]), ("near Mara Falls, Hybrid", [1]), ("Tulominster (AT) | Tulominster (GB)", [2, 3]), ("x" * 100_000, []),
    ],
)
def test_places(value, ids):
    assert Places(ENTRIES).find(value) == ids


def test_places_of_rows(spark):
    a, b = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    rows = [("1", "Canada", a), ("1", "kanada", b), ("2", None, a), ("3", "  ", a), ("4", "Mara Falls", a), ("5", "nowhere", None), (None, "Canada", a), ("6", "Canada; Linismünde", a)]
    df = spark.createDataFrame(rows, "k string, v string, at timestamp").transform(clashing)
    assert sorted(map(tuple, map_places(df, "k", "v", "at", ENTRIES, True).collect())) == [("1", 10), ("5", 0), ("6", 4), ("6", 10)]
    assert map_places(df.limit(0), "k", "v", "at", ENTRIES).collect() == [] and {x.place_id for x in map_places(df, "k", "v", "at", []).collect()} == {0}
    table = spark.createDataFrame([(1, "A", "city", None, None), (None, "B", "city", None, []), (2, None, "city", "DE", [])], "place_id int, name string, kind string, country_code string, other_names array<string>")
    assert place_entries(table) == [Entry(1, "A", "city", None, ())]


def test_a_region_no_list_knows_stays_beside_a_city():
    entries = [*ENTRIES, Entry(24, "Nordics", "region", None, ())]
    assert Places(entries).find("Nordics or Mara Falls") == [24, 1] and Places(entries).find("Europe or Mara Falls") == [20, 1]
    assert Places(entries, regions={"nordics": ["CA"]}).find("Nordics or Mara Falls") == [1] and Places(entries).find("Worldwide, Mara Falls") == [1]


def test_places_outside_all_lists(spark):
    """Invented places, typed with errors among invented words around them: recall and precision."""
    r = random.Random(8)
    make = lambda: "".join(r.choice(["ka", "lo", "mi", "nur", "pel", "ra", "sto", "ti", "vu", "xen", "zol", "bri"]) for _ in range(r.randrange(3, 6))).title()
    names = sorted({make() for _ in range(60)})
    entries = [Entry(i, n, "city", "QX", ()) for i, n in enumerate(names, 1)]
    rows, want = [], set()
    for k in range(1500):
        e = r.choice(entries)
        name = e.name
        if k % 3 == 0:
            at = r.randrange(1, len(name) - 1)
            name = r.choice([name[:at] + name[at + 1 :], name[:at] + "q" + name[at:], name[:at] + name[at + 1] + name[at] + name[at + 2 :]])
        if k % 10 == 9:
            rows.append((str(k), f"Wubbel {make()}qq"))
            continue
        rows.append((str(k), r.choice(["{} wubbel", "flonk {}", "{}, snork 7", "{}"]).format(name)))
        want.add((str(k), e.id))
    df = spark.createDataFrame([(k, v, None) for k, v in rows], "k string, v string, at timestamp")
    got = {tuple(x) for x in map_places(df, "k", "v", "at", entries).collect() if x.place_id}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


# --- 5 -------------------------------------------------------------------------------------------------------------
def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_segment_join_loses_nothing(spark):
    r = random.Random(6)
    names = {"".join(r.choice("abc") for _ in range(r.randrange(3, 13))) for _ in range(150)}
    for x in list(names)[:60]:
        i = r.randrange(len(x))
        names.add(x[:i] + r.choice("abc") + x[i + r.randrange(2) :])
    rows = [(i, r.choice(["p", "q", ""]), x) for i, x in enumerate(sorted(names))]
    got = {(x.a, x.b) for x in close_brands(spark.createDataFrame([(*x, 0) for x in rows], "node bigint, line string, key string, last int")).collect()}
    for (i, li, x), (j, lj, y) in combinations(rows, 2):
        d = edit_distance(x, y)
        swapped = len(x) == len(y) and sorted(x) == sorted(y)
        close = d <= 1 or (d == 2 and (swapped or min(len(x), len(y)) >= 9))
        assert ((min(i, j), max(i, j)) in got) == (close and (li == lj or not li or not lj)), (x, y, li, lj)


@pytest.mark.parametrize(
    "name, parts",
    [
        ("Dotego Dapi Textiles GmbH", (("dotego", "dapi"), "textiles", "gmbh")), ("DAPI, DOTEGO Text. G.m.b.H. - Careers", (("dapi", "dotego"), "textiles", "gmbh")), ("Nuza-Wutredri Beratung GmbH&Co.KG", (("nuza", "wutredri"), "consulting", "gmbhkg")), ("N. Wutredri Consulting GmbH und Co. KG (Holding)", (("n.", "wutredri"), "consulting", "gmbhkg")),
        ("SkigrahoZetru Robotics SE", (("skigraho", "zetru"), "robotics", "se")), ("Hwelögare UG (haftungsbeschränkt)", (("hwelogare",), "", "ug")), ("Kuelu Enrg. B.V", (("kulu",), "energy", "bv")), ("Külu Eng. S. A. S.", (("kulu",), "engineering", "sas")), ("Robotecs Skigraho Zetru", (("skigraho", "zetru"), "robotics", "")),
    ],
)
def test_names_taken_apart(name, parts):
    assert tuple(parse(name)) == parts


def test_no_names():
    assert [parse(x) for x in (None, "", "  ", "n/a", "Confidential", "-", "...", "Vertraulich")] == [None] * 8
    assert parse("Group") is not None and parse("x" * 100_000).words == ("x" * 100_000,)
    assert near("abcd", "abdc") and near("abc", "abcd") and not near("abcd", "badc")


def test_employers(spark):
    same = [
        ["Dotego Dapi Textiles GmbH"] * 9 + ["dotego  dapi textiles gmbh", " Dotego Dapi Textiles GmbH ", "Dotego-Dapi Textilien", "Dapi, Dotego Text. G.m.b.H.", "D. Dapi Textiles GmbH", "Dotego Textiles GmbH", "Dotgeo Dapi Textiles GmbH", "Dotego Dapi GmbH", "DotegoDapi Textiles GmbH | Jobs"],
        ["Dotego Dapi Robotics AG"] * 7 + ["Dotego Dapi Robotik AG", "Dotego Dapi AG"],
        ["Rastigrelevi Energy SE"] * 5 + ["Rastigre Energy SE", "Rastigrelevi Energie"],
        ["Stable Optics"] * 4,
    ]
    rows = [(x,) for group in same for x in group] + [(None,), ("",), ("n/a",), ("Confidential",)] * 3
    found = employers(spark.createDataFrame(rows, "company string").transform(clashing), "company")
    clusters = defaultdict(set)
    for x in found.collect():
        clusters[x.employer].add(x.name)
    assert {k: v for k, v in clusters.items()} == {g[0]: set(g) for g in same}
    pairs = {tuple(x) for x in spelling_pairs(found).collect()}
    assert pairs == {tuple(sorted(p, key=lambda s: s.encode())) for g in same for p in combinations(set(g), 2)}
    assert employers(spark.createDataFrame([], "company string"), "company").collect() == []


TRADES = "dental rental gardening plumbing catering forestry aviation roofing".split()


def test_lines_outside_the_lexicon(spark):
    """Trades no list names are counted in the names; recall and precision of spellings over them."""
    r = random.Random(3)
    syllables = "ka lo mi nu pe ra so ti vu xe zo bri dru fle gno klu".split()
    brands = sorted({"".join(r.choice(syllables) for _ in range(4)) for _ in range(60)})
    meant = {}
    for brand in brands:
        for trade in r.sample(TRADES, 2):
            name = f"{brand.title()} {trade.title()}"
            k = r.randrange(1, len(brand) - 1)
            other = brand[:k] + r.choice("bdfgh") + brand[k + 1 :]
            for spelling in (name, f"{name} GmbH", name.upper(), f"{trade.title()}, {brand.title()}", f"{other.title()} {trade.title()}"):
                meant[spelling] = (brand, trade)
    rows = [(x,) for x in meant for _ in range(4 if x.istitle() and "," not in x else 1)]
    got = {tuple(x) for x in spelling_pairs(employers(spark.createDataFrame(rows, "name string"), "name")).collect()}
    want = {tuple(sorted(p)) for p in combinations(meant, 2) if meant[p[0]] == meant[p[1]]}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9


def test_two_trades_of_one_brand_stay_apart(spark):
    rows = [(x,) for x in ("Novatec Dental GmbH", "Novatec Rental GmbH", "Novatec Dentla GmbH", "Team Viewer GmbH", "Viewer GmbH", "alpha beta gamma", "Gamma Alpha Beta")]
    got = {tuple(x) for x in spelling_pairs(employers(spark.createDataFrame(rows, "name string"), "name")).collect()}
    assert got == {("Novatec Dental GmbH", "Novatec Dentla GmbH"), ("Gamma Alpha Beta", "alpha beta gamma")}


def test_own_lines(spark):
    names = [f"{b} {t}" for b in ("Kalo", "Minu", "Pera", "Soti", "Vuxe", "Zobri") for t in ("Dental", "Foods")] + [f"{b} Zahn" for b in ("Kalo", "Minu", "Pera", "Soti", "Vuxe")] + [f"Kalo {x}" for x in ("River", "Stone")]
    frame = spark.createDataFrame([(n, 1) for n in names], "name string, n bigint")
    assert own_lines(frame) == {"dental": "dental", "zahn": "dental"} or own_lines(frame) == {"dental": "dental", "zahn": "foods"}


# --- 6 -------------------------------------------------------------------------------------------------------------
def test_leaks_like_brute_force(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(WORDS[:20]) for _ in range(r.choice([3, 8, 11, 12, 20, 30])))) for i in range(30)] + [(30, None), (31, ""), (None, "x y z")]
    docs = []
    for d in range(120):
        text = [r.choice(WORDS[:25]) for _ in range(60)]
        if d % 2:
            words = r.choice(items[:30])[1].split()
            a = r.randrange(len(words))
            text[20:20] = words[a : a + r.randrange(5, 40)] if d % 4 == 1 else words
        docs.append((d, r.choice([" ", ", ", " <b>", "\n"]).join(text).upper() if d % 3 else " ".join(text)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, "long " * 300_000 + items[0][1]), (902, "again")]
    found = eval_leaks(spark.createDataFrame(docs, "d bigint, t string").transform(clashing), "d", "t", spark.createDataFrame(items, "i bigint, t string").transform(clashing), "i", "t")
    got = {(x.doc_id, x.item_id) for x in found.collect() if x.verbatim_windows}
    words = lambda t: re.findall(r"[^\W_]+", re.sub(r"<[^>]*>", " ", t or "").lower())
    want = set()
    for i, t in items:
        w = words(t)
        n = min(12, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n and i is not None else set()
        for d, text in docs:
            v = words(text)
            if d is not None and any(tuple(v[k : k + n]) in windows for k in range(len(v) - n + 1)):
                want.add((d, i))
    assert got == want and len(want) > 20


def test_other_parameters_are_leaks_too(spark):
    item = "If Plostaly handles 18 requests while the ticket queue drops 7, how many clinics must Plostaly reassure before noon?"
    same = item.replace("Plostaly", "Womox").replace("18", "220").replace("7,", "31,")
    mixed = item.replace("Plostaly", "Womox", 1)
    items = spark.createDataFrame([(1, item)] + [(i, "if while the ticket queue drops how many must reassure before handles") for i in range(2, 40)], "i int, t string")
    docs = spark.createDataFrame([(1, "x " + same), (2, "y " + item), (3, "nothing of the kind")], "d int, t string")
    got = {(x.doc_id, x.verbatim_windows > 0, x.changed_windows > 0) for x in eval_leaks(docs, "d", "t", items, "i", "t").where("item_id = 1").collect()}
    assert (1, False, True) in got and any(d == 2 and v for d, v, _ in got) and not any(d == 3 for d, *_ in got)
    whole = eval_leaks(spark.createDataFrame([(1, mixed)], "d int, t string"), "d", "t", items, "i", "t", window=len(re.findall(r"\w+", item))).where("item_id = 1")
    assert whole.count() == 0  # one slot value of the item stands for two of the document


def test_recall_and_precision_of_changed_items(spark):
    """Items of ten forms, and passages of the same forms with other names and numbers: each passage is found once, for one item of its form."""
    r = random.Random(12)
    lower = [w for w in WORDS if w.islower()]
    name = lambda: "".join(r.choice(["Ka", "Lo", "Mi"]) + r.choice(["nur", "pel", "stot"]) for _ in range(1)) + "".join(r.choice(lower) for _ in range(2))
    forms = [" ".join(r.choice(lower) if k % 5 else r.choice(["{N}", "{7}"]) for k in range(1, 26)) for _ in range(10)]

    def filled_in(form):
        who, many = name().title(), str(r.randrange(2, 9999))
        return form.replace("{N}", who).replace("{7}", many)

    items = [(i, i % 10, filled_in(forms[i % 10])) for i in range(40)]
    docs = []
    for d in range(200):
        filler = " ".join(r.choice(lower) for _ in range(80))
        form = r.randrange(10) if d % 2 else None
        docs.append((d, form, f"{filler} {filled_in(forms[form]) if form is not None else ''} {filler[:200]}"))
    found = eval_leaks(spark.createDataFrame([(d, t) for d, _, t in docs], "d int, t string"), "d", "t", spark.createDataFrame([(i, t) for i, _, t in items], "i int, t string"), "i", "t")
    rows = [(x.doc_id, x.item_id) for x in found.collect()]
    form_of = {d: f for d, f, _ in docs}
    right = {d for d, i in rows if form_of[d] == i % 10}
    wanted = {d for d, f in form_of.items() if f is not None}
    assert len(right) / len(wanted) > 0.9 and sum(form_of[d] == i % 10 for d, i in rows) / len(rows) > 0.9
    assert len(rows) <= 1.1 * len(wanted)  # not one row for each item of the form


def test_a_passage_that_changes_its_names_on_the_way_is_none(spark):
    item = "when Plostaly reads the first of all pages then Plostaly writes the last of all pages and Plostaly signs the whole of all books"
    broken = item.replace("Plostaly", "Womox", 1).replace("Plostaly", "Dapuk", 1).replace("Plostaly", "Womox")
    items = spark.createDataFrame([(1, item)] + [(i, item.replace("Plostaly", "and").lower()) for i in range(2, 40)], "i int, t string")
    docs = spark.createDataFrame([(1, item.replace("Plostaly", "Womox")), (2, broken)], "d int, t string")
    got = {x.doc_id for x in eval_leaks(docs, "d", "t", items, "i", "t").where("item_id = 1").collect()}
    assert got == {1}


def test_an_item_that_is_a_name_matches_only_itself(spark):
    items = spark.createDataFrame([(1, "Plostaly")] + [(i, "all of these words are small ones") for i in range(2, 60)], "i int, t string")
    docs = spark.createDataFrame([(1, "Some unknown words here"), (2, "here is Plostaly again")], "d int, t string")
    assert [tuple(x) for x in eval_leaks(docs, "d", "t", items, "i", "t").collect()] == [(2, 1, 1, 0)]


def test_too_many_characters_are_refused(spark, monkeypatch):
    monkeypatch.setattr(leaks_module, "MAX_CHARACTERS", 10)
    items = spark.createDataFrame([(1, "more than ten characters")], "i int, t string")
    with pytest.raises(TooLarge):
        eval_leaks(items, "i", "t", items, "i", "t")


# --- 7 -------------------------------------------------------------------------------------------------------------
def test_filling_to_caps():
    assert filled({"a": 1, "b": 1}, {"a": 10, "b": 100}, 40) == {"a": 10, "b": 30}
    assert filled({"a": 3, "b": 1}, {"a": 100, "b": 100}, 40) == {"a": 30, "b": 10}
    assert filled({"a": 1, "b": 0}, {"a": 5}, 40) == {"a": 5, "b": 0} and filled({}, {}, 1) == {}


def test_mix_shares_and_caps(spark):
    r = random.Random(9)
    sources = ["big"] * 60 + ["mid"] * 25 + ["small"] * 5
    docs = [(i, r.choice(sources), " ".join(r.choice(WORDS) for _ in range(r.randrange(5, 80)))) for i in range(4000)] + [(5000, None, "no source"), (5001, "big", None), (5002, "big", ""), (None, "big", "x"), (5003, "mid", "y " * 20_000)]
    targets = [("p", "big", 1.0, 1, 0.5), ("p", "mid", 1.0, 2, 0.5), ("p", "small", 0.3, 3, 0.5), ("p", "none", 1.0, 3, 0.5), ("q", "small", 2.0, 2, 9.0), (None, "big", 1.0, 1, 1.0), ("z", "big", None, 1, 1.0)]
    shape = "plan string, source string, target_weight double, max_repeats int, size_ratio double"
    mixed, shares = mix(spark.createDataFrame(docs, "d bigint, s string, t string").transform(clashing), "d", "s", "t", spark.createDataFrame(targets, shape), queries.TOKENIZER, block_tokens=256)
    uses = Counter((x.plan, x.source, x.id) for x in mixed.collect())
    caps = {(p, s): n for p, s, _, n, _ in targets}
    assert all(n <= caps[p, s] for (p, s, _), n in uses.items()) and mixed.groupBy("plan", "id", "copy").count().where("count > 1").count() == 0
    got = {(x.plan, x.source): x for x in shares.collect()}
    assert got["p", "none"].mix_tokens == 0 and got["z", "big"].mix_tokens == 0 and (None, "big") not in got
    for s, w in (("big", 1.0), ("mid", 1.0), ("small", 0.3)):
        assert abs(got["p", s].actual_share - w / 2.3) < 0.04
    small = got["q", "small"]
    assert 1.9 * small.source_tokens <= small.mix_tokens <= 2 * small.source_tokens
    total = sum({x.source: x.source_tokens for x in got.values()}.values())
    assert abs(sum(x.mix_tokens for (p, _), x in got.items() if p == "p") / total - 0.5) < 0.04  # one document has 20,000 tokens
    prefix = [x.source for x in mixed.where("plan = 'p'").select("slot", "source").distinct().orderBy("slot").limit(40).collect()]
    assert abs(prefix.count("big") - 40 / 2.3) < 5  # any run of slots is near the shares
    a, b = mix(spark.createDataFrame([], "d bigint, s string, t string"), "d", "s", "t", spark.createDataFrame(targets, shape), queries.TOKENIZER)
    assert a.collect() == [] and {x.mix_tokens for x in b.collect()} == {0}


def test_no_block_is_empty_and_long_documents_count_by_their_tokens(spark):
    """Documents of many blocks among short ones: the shares hold, and every slot has a document."""
    docs = [(i, "ab"[i % 2], "y " * (4000 if i % 2 == 0 and i % 20 == 0 else 60)) for i in range(1200)]
    shape = "plan string, source string, target_weight double, max_repeats int, size_ratio double"
    targets = spark.createDataFrame([("p", "a", 1.0, 2, 0.4), ("p", "b", 1.0, 3, 0.4)], shape)
    mixed, shares = mix(spark.createDataFrame(docs, "d bigint, s string, t string"), "d", "s", "t", targets, queries.TOKENIZER, block_tokens=256)
    slots = {x.slot for x in mixed.select("slot").distinct().collect()}
    assert slots == set(range(len(slots))) and all(abs(x.actual_share - 0.5) < 0.06 for x in shares.collect())


# --- 8 -------------------------------------------------------------------------------------------------------------
def brute_spans(docs, least):
    where = defaultdict(set)
    for d, t in docs.items():
        for i in range(len(t) - least + 1):
            where[t[i : i + least]].add(d)
    out = {}
    for d, t in docs.items():
        covered = set()
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                covered.update(range(i, i + least))
        if covered:
            out[d] = len(covered)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_spans_like_brute_force(spark, seed):
    r = random.Random(seed)
    letters = "ab" if seed == 3 else "abcdefgh ü😀"
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [make(r.randrange(20, 120)) for _ in range(6)]
    docs = {d: make(r.randrange(0, 60)) + r.choice(shared)[r.randrange(5) :] + make(r.randrange(60)) + r.choice([r.choice(shared), "", "aaaa" * 15]) for d in range(60)}
    docs |= {100: docs[0], 101: docs[0], 102: shared[0], 103: "", 104: "a" * 300, 105: "a" * 290, 106: docs[1] * 3}
    df = spark.createDataFrame(list(docs.items()), "d bigint, t string")
    got = {x.id: x for x in shared_chars(df, "d", "t", least=40).collect()}
    want = brute_spans(docs, 40)
    assert {d: x.shared_chars for d, x in got.items()} == want and all(x.n_chars == len(docs[d]) for d, x in got.items())
    covered = defaultdict(set)
    for x in shared_spans(df, "d", "t", least=40).collect():
        part = docs[x.id][x.start : x.start + x.length]
        assert len(part) == x.length >= 40 and any(part in t for d, t in docs.items() if d != x.id)
        covered[x.id].update(range(x.start, x.start + x.length))
        assert x.shared_chars == want[x.id] and x.n_chars == len(docs[x.id])
    assert {d: len(c) for d, c in covered.items()} == want


def brute_stretches(docs, least):
    out = set()
    for d, t in docs.items():
        others, last = [x for e, x in docs.items() if e != d], -1
        for i in range(len(t) - least + 1):
            end = max(last, i + least)
            if not any(t[i:end] in x for x in others):
                continue
            while end < len(t) and any(t[i : end + 1] in x for x in others):
                end += 1
            if end > last:
                out.add((d, i, end - i))
                last = end
    return out


@pytest.mark.parametrize("seed", range(3))
def test_stretches_like_brute_force(spark, seed):
    """Stretches cut from a common text at all places, so that partners overlap, contain and touch each other."""
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcdefgh ü😀") for _ in range(n))
    base = [make(600) for _ in range(3)]
    docs = {}
    for d in range(40):
        parts = []
        for _ in range(r.randrange(1, 4)):
            t, a = r.choice(base), r.randrange(560)
            parts += [make(r.randrange(30)), t[a : a + r.randrange(20, 300)]]
        docs[d] = "".join(parts)
    got = [(x.id, x.start, x.length) for x in shared_spans(spark.createDataFrame(list(docs.items()), "d bigint, t string"), "d", "t", least=40).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_stretches(docs, 40) and len(got) > 60


def test_halves_held_by_two_others_are_two_stretches(spark):
    r = random.Random(2)
    a, b = ("".join(r.choice("abcdefgh") for _ in range(500)) for _ in "ab")
    docs = {1: a + b, 2: "1" + a + "2", 3: "3" + b + "4", 4: a[:450] + "5", 5: a[100:] + b[:420]}
    got = {(x.id, x.start, x.length) for x in shared_spans(spark.createDataFrame(list(docs.items()), "d bigint, t string"), "d", "t").collect()}
    assert got == {(1, 0, 500), (1, 100, 820), (1, 500, 500), (2, 1, 500), (3, 1, 500), (4, 0, 450), (5, 0, 820)}


def test_span_edges(spark):
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh") for _ in range(500))
    rows = [(1, t), (1, t), (2, None), (None, t), (3, t[:399]), (4, "z" + t[:400]), (5, "y" * 1_500_000), (6, "x" + "y" * 1_000_000)]
    df = spark.createDataFrame(rows, "d bigint, t string").transform(clashing)
    want = {1: 400, 4: 400, 5: 1_500_000, 6: 1_000_000}
    for operator in (shared_chars, shared_spans):
        assert {x.id: x.shared_chars for x in operator(df, "d", "t").collect()} == want
        assert operator(df.limit(0), "d", "t").collect() == [] and operator(df.where("d = 1"), "d", "t").collect() == []
