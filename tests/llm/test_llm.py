"""The corpus operators: against SQL, against brute force, and on odd input."""

import hashlib
import html
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import rows_of
from plumbline.llm import common, decontam, exact, mixing, neardup, periodic, pii, quality, queries, sharding, substring, tokencount, vectors, wrappers
from plumbline.llm.common import IdFilter, WordHash, gram_hashes
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
#: Nulls in every column, empty and very long texts, ties, repeated rows.
ODD = [
    (None, "no id at all", None, None, None), (1, None, "en", "a", None), (2, "", "en", None, 0), (
        3, "   \n\t ", "en", "a", 6,
    ), (4, LONG, "en", "b", len(LONG)), (5, "same words here", "en", "a", 1), (6, "same words here", "de", "b", 2),
    (7, "one", "en", "a", 3), (8, "one", "en", "a", 3), (8, "one", "en", "a", 3), (
        9, "é ü 漢字 😀 x@y.org 10.0.0.1", None, "c", 9,
    ), (10, "1" * 50_000, "en", "c", 9), (11, "<p>&amp;", "en", "c", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(name, spark, data_dir, duck):
    got, want = queries.QUERIES[name](spark, data_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


OPERATORS = {
    "quality": lambda d, s: quality.quality_scores(
        d, s.createDataFrame([(4, 1), (5, 0), (None, 1), (7, 5)], "doc_id long, quality int"),
    ), "near": lambda d, s: neardup.near_dup_groups(d, 3, 85),
    "decontam": lambda d, s: decontam.decontaminate(
        d, s.createDataFrame([(1, "same words"), (None, None), (3, ""), (3, LONG)], "item_id long, text string"),
    ), "pii": lambda d, s: pii.find_pii(d),
    "wrappers": lambda d, s: wrappers.extract_text(
        d.withColumns({"page_id": F.col("doc_id"), "url": F.col("source"), "html": F.col("text")})
    ), "mix": lambda d, s: mixing.mix_plan(d), "substring": lambda d, s: substring.substring_dedup(d),
    "tokens": lambda d, s: tokencount.token_counts(
        d
    ), "shard": lambda d, s: sharding.place(d), "exact": lambda d, s: exact.exact_groups(d),
    "runs": lambda d, s: periodic.run_digests(periodic.periodic_runs(periodic.planted(d))),
    "vectors": lambda d, s: vectors.near_vectors(d.withColumns({
        "vec_id": F.col("doc_id"), "embedding": F.array(F.col("n_chars").cast("float"), F.length("text").cast("float")),
    })),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_empty_tables_and_clashing_columns(name, spark, odd, none):
    op = OPERATORS[name]
    clash = odd.withColumns(
        {
            c: F.lit("x")
            for c in (
                "score", "kept", "taken", "shard", "slot", "set", "h", "rep", "block", "target", "items", "hits", "n",
                "y", "t", "bits", "host",
            )
        }
    )
    assert op(odd, spark).count() == len(ODD) == op(clash, spark).count()
    assert op(none, spark).count() == 0
    assert rows_of(op(odd, spark).toPandas()) == rows_of(op(odd.repartition(3), spark).toPandas())


LABELS = [(4, 1), (5, 0), (None, 1), (7, 5), (9, 1), (10, 0), (12, None)]
BENCH = [(1, "same words"), (None, None), (3, ""), (4, LONG)]
#: Operators that give rows of their input, with all its columns.
FILTERS = {
    "keep_good": lambda d, s: quality.keep_good(
        d, s.createDataFrame(LABELS, "doc_id long, quality int"),
    ), "drop_near_dups": lambda d, s: neardup.drop_near_dups(d), "drop_contaminated": lambda d, s: decontam.drop_contaminated(d, s.createDataFrame(BENCH, "item_id long, text string")),
    "mix_sources": lambda d, s: mixing.mix_sources(d), "exact_dedup": lambda d, s: exact.exact_dedup(d),
}
CLASH = "_copies _i _id _row _source _at _words _whole _cut _s _block _bits _bit _maybe _sha _kept _one _gone _slot _text score kept slot_ shard_ hits items set rep n y x h".split()


@pytest.mark.parametrize("name", list(FILTERS))
def test_filters_keep_rows_whole(name, spark, odd, none):
    op = FILTERS[name]
    plain = op(odd, spark)
    want = Counter(map(repr, plain.select("doc_id", "text", "source").collect()))
    clash = odd.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    got = op(clash, spark)
    assert plain.columns == odd.columns and got.columns == clash.columns and plain.dtypes == odd.dtypes
    rows = got.collect()
    assert Counter(map(repr, [r.__class__(**{c: r[c] for c in ("doc_id", "text", "source")}) for r in rows])) == want
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH)
    assert op(none, spark).count() == 0 and op(none, spark).columns == none.columns
    assert set(want) <= set(map(repr, odd.select("doc_id", "text", "source").collect()))
    assert Counter(map(repr, op(odd.repartition(3), spark).select("doc_id", "text", "source").collect())) == want


def test_what_filters_do_with_odd_rows(spark, odd):
    ids = lambda name: Counter(r["doc_id"] for r in FILTERS[name](odd, spark).select("doc_id").collect())
    every = Counter(r[0] for r in ODD)
    near = ids("drop_near_dups")
    assert near == every - Counter({6: 1, 8: 2}) and near[None] == 1 and near[1] == near[2] == near[3] == 1  # no words: nobody's copies
    assert ids("exact_dedup") == every - Counter({1: 1, 5: 1, 7: 1, 8: 1})  # null counts as empty, the largest id stays
    assert ids("drop_contaminated") == every - Counter({4: 1, 5: 1, 6: 1})
    assert all(0 <= n <= 2 * every[d] for d, n in ids("mix_sources").items())
    placed = sharding.place(odd.withColumns({c: F.lit("x") for c in ("slot", "shard", "_at", "_slot", "SLOT_")}), 5)
    assert placed.columns == [
        *odd.columns, "_at", "_slot", "SLOT_", "slot", "shard",
    ] and placed.filter("_slot = 'x' and _at = 'x'").count() == len(ODD)


def test_redaction_of_odd_texts(spark, odd):
    spans = pii.find_pii(odd).select("doc_id", "spans").distinct()
    rows = odd.filter("doc_id is not null").join(spans, "doc_id").select(
        "text", "spans", pii.redact_pii(F.col("text"), F.col("spans")).alias("r"),
    ).collect()
    assert all(
        (r["r"] is None) == (r["text"] is None) for r in rows
    ) and any("[email] [ip]" in (r["r"] or "") for r in rows)


def test_ids_with_several_texts_are_left_alone(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, b + " b"), (5, c)]
    got = sorted(
        tuple(r) for r in neardup.drop_near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    )
    assert got == [(1, a), (2, a), (2, b), (3, c), (4, b + " b")]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_rows_by_ids(few, spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_IDS", few)
    rows = [(i % 3000 if i % 11 else None, f"t{i}", "own") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _block string").repartition(4)
    ids = common.materialise(spark.range(0, 3000, 7).withColumnRenamed("id", "gone"), "ids")
    gone = set(range(0, 3000, 7))
    assert sorted(
        r["text"] for r in common.with_ids(docs, ids, "doc_id").collect()
    ) == sorted(t for i, t, _ in rows if i in gone)
    left = common.without_ids(docs, ids, "doc_id")
    assert left.columns == docs.columns and sorted(r["text"] for r in left.collect()) == sorted(
        t for i, t, _ in rows if i not in gone
    )


def test_broadcast_filter_of_many_partitions(spark):
    held = common.id_filter(spark.range(0, 200_000, 2).repartition(7)).value
    assert held.maybe(np.arange(0, 200_000, 2)).all() and held.maybe(np.arange(1, 200_000, 2)).mean() < 0.02
    places = np.array([0, 5, 65_535])
    assert np.flatnonzero(common.unpack(common.pack(places))).tolist() == places.tolist()
    assert np.flatnonzero(common.unpack(common.pack(np.arange(0, 65_536, 3)))).tolist() == list(range(0, 65_536, 3))
    assert not common.id_filter(spark.range(0)).value.maybe(np.arange(10)).any()


# ---------------------------------------------------------------- 1: quality


def test_ranker_learns_and_holds_out(spark, data_dir):
    big = data_dir.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality.quality_scores(d, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert set(
        quality.train_part(d, labels).toPandas()["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3)
    ) == {0, 2}


def test_one_kind_of_label_gives_even_scores(spark, odd):
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(odd, labels).collect()} == {0.5}


# ---------------------------------------------------------------- 2: near duplicates


def brute_groups(texts: dict, k: int, percent: int) -> dict:
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for o, n in Counter(o for g in s for o in holders[g] if o < d).items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(o), find(d)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_family(seed: int, n: int) -> list[tuple]:
    """Variants of one text with a few words changed, more in some than links allow, and chains of small steps."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    rows = []
    for i in range(n):
        words = list(base)
        for j in rng.choice(120, rng.integers(0, 9), replace=False):
            words[j] = f"x{rng.integers(0, 60)}"
        rows.append((1000 + i, " ".join(words)))
    step = list(base[:60])
    for i in range(25):
        step[i * 2] = f"s{i}"
        rows.append((2000 + i, " ".join(step)))
    rng.shuffle(rows)
    return [(int(d), str(t)) for d, t in rows]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, texts, k, percent):
    more = dict(near_family(k, 120))
    both = texts | more
    frame = spark.createDataFrame(list(both.items()), "doc_id long, text string")
    got = neardup.near_dup_groups(frame, k, percent).collect()
    want = brute_groups(both, k, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_sketches_merge_and_estimate():
    of, rng = WordHash().of, np.random.default_rng(1)
    words = [b"%d" % i for i in rng.integers(0, 10**9, 3000)]
    a, b = neardup.shingle_set(of(words[:2000]), 3), neardup.shingle_set(of(words[200:]), 3)
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert (np.maximum(ra, rb) == neardup.registers(np.union1d(a, b))).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    est = neardup.likely_jaccard(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert abs(est - true) < 0.15


# ---------------------------------------------------------------- 3: decontamination


def test_blocks_agree_and_spans_go(spark, docs, data_dir):
    bench = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    one, many = (decontam.decontaminate(docs, bench, block_chars=n).orderBy("doc_id").toPandas() for n in (10**9, 2000))
    assert one.equals(many)
    hit = set(one[one["contaminated"]]["doc_id"])
    assert hit and {
        r["doc_id"] for r in decontam.drop_contaminated(docs, bench).select("doc_id").collect()
    } == set(one["doc_id"]) - hit
    clean = spark.createDataFrame(one[["doc_id", "clean_text"]]).withColumnRenamed("clean_text", "text")
    assert (
        decontam.decontaminate(clean, bench).toPandas()["n_words"].sum()
    ) == one["n_words"].sum() - one["n_hit"].sum()


def test_a_set_of_grams_is_arrays_and_small():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50_000, 400))) for i in range(1000)]
    held = decontam.GramSet([*items, (None, "two words"), (7, "two words"), (8, None)], 10)
    size = len(pickle.dumps(held))
    assert size < 45 * 400 * 1000 and set(held.windows) == {2, 10}  # some 30 bytes a word and the text
    text = ["x y " + " ".join(items[5][1].split()[3:20]) + " two words", None, "two, Words"]
    found = list(decontam._scanned(held, text))
    assert {i for d, i, k, _ in found if (d, k) == (0, 10)} == set(range(2, 10)) and {
        n for d, _, k, ns in found if k == 10 for n in ns
    } == {"5"}
    assert [
        (d, i, k, sorted(ns)) for d, i, k, ns in found if k == 2
    ] == [(0, 19, 2, ["7", "None"]), (2, 0, 2, ["7", "None"])]


# ---------------------------------------------------------------- 4: personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind: str, v: str) -> bool:
    d = [int(c) for c in v if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        doubled = [c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base_spans(text: str) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0])]


def test_base_spans_equal_brute_force_and_looser_ones_join(spark, texts):
    more = {
        9001: "mail bob.x@a-b.co.uk_y@z.org, 1.2.3.4.5.6.7.8 and 300.1.1.1 001.002.3.255", 9002: "call (212) 555-1234 or joe [at] site [dot] com; 4111 1111 1111 1111 4111-1111-1111-1112", 9003: "é@x.y ü+1 (555) 123-4567.+44 20 7946 0958 9",
        9004: "+1234567 a@b a@b.c.d.e. tel 212-555-0199", 9005: "1." * 700 + "1", 9006: "a." * 3000 + "@x",
    }
    both = texts | more
    got = {
        r["doc_id"]: r
        for r in pii.find_pii(spark.createDataFrame(list(both.items()), "doc_id long, text string")).collect()
    }
    for d, t in both.items():
        want = base_spans(t)
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), d
        assert set(want) <= set(got[d]["spans"].split(",") if got[d]["spans"] else []), d
        assert got[d]["n_email"] == sum(x.startswith("email") for x in want)
    assert "phone:5:19" in got[9002]["spans"]
    clean = spark.createDataFrame(
        [(more[9004], got[9004]["spans"])], "t string, s string",
    ).select(pii.redact_pii(F.col("t"), F.col("s"))).first()[0]
    assert clean.startswith("+1234567 a@b [email]. tel ")
    for r in got.values():
        assert set(r["doubtful"].split(",")) - {""} <= set(r["spans"].split(","))


def test_what_the_classifier_sees_and_long_texts(spark):
    many = " ".join(f"a{i}@b{i}.org, ({200 + i % 700}) 555-{i:04d} mid{i}@x.y(212) 555-9999" for i in range(900))
    rows = spark.createDataFrame([(1, "Tel: (212) 555-1234"), (2, many)], "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in pii.candidates(rows, "doc_id", "text").collect()}
    one = found[1][0]
    assert (one["kind"], one["base"], one["seen"]) == (3, False, "233010") and len(one["seen"]) == len(pii.SEEN)
    base = [x for x in found[2] if x["base"]]
    loose = [x for x in found[2] if not x["base"]]
    assert len(base) == 1800 and len(loose) >= 900 and not any(
        x["start"] < y["end"] and y["start"] < x["end"] for x in loose for y in base[::7]
    )


def test_em_trusts_labelers_that_agree():
    counts = {"110011": 80, "100011": 10, "020022": 40, "000022": 10, "012000": 3}
    _, tables, belief = pii.reliabilities(counts)
    assert belief["110011"] > 0.9 > 0.1 > belief["020022"] and tables[0]["1"][1] > tables[0]["1"][0]
    rows = [
        {"kind": 3, "votes": v, "seen": "312011" if belief[v] > 0.5 else "512011", "crowd": "0", "n": n}
        for v, n in counts.items()
    ]
    w = pii.trained(rows)[3]
    assert w["v01"] > 0 > w["v12"] and w["s03"] > 0 > w["s05"] and pii.trained([]) == [{}, {}, {}, {}]


# ---------------------------------------------------------------- 5: pages


def test_pages_equal_a_plain_reading(spark, data_dir):
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in wrappers.extract_text(pages).collect():
        main = re.search(r"<article>(.*?)(?:</article>|$)", source[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", main.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_what_isnt_the_article_goes():
    page = """<html><body><header><h2>Site</h2></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div>
    <main><h1>Title &amp; more</h1><p>First <b>bold<br>line</p><aside>Side</aside><form>Send<input></form><script>if (a<b) "</p>"</script>
    <div class="ad">Buy</div><ul><li>One<li>Two</ul><table><tr><td>A<td>B</table><section id="comments"><p>Nice!</p></section></main><footer>Foot</footer><p"""
    found = wrappers.blocks(page)
    lens = {p: len(t) for p, t in found}
    assert [
        t for p, t in found if wrappers.is_content(p, wrappers.main_element(lens))
    ] == ["Title & more", "First bold line", "One", "Two", "A", "B"]


@pytest.mark.parametrize(
    ("names", "away"),
    [
        ("share price", False), ("related-work", False), (
            "comment-on-policy", False,
        ), ("social-policy", False), ("responsive", False), ("adventure", False), ("header", False), ("share-buttons", True), ("comments", True), ("related-posts box", True),
        ("cookie-notice", True), ("adBanner", True), ("ad clearfix", True), ("newsletterSignup wide", True), (
            "user-comments-list dark", True,
        ), ("widget", True), ("social", True), ("", False),
    ],
)
def test_names_that_say_no_content(names, away):
    page = f'<body><article><h1>T</h1><div class="{names}">Text</div><section id="{names.replace(" ", "-")}"><p>More</p></section></article></body>'
    found = [t for p, t in wrappers.blocks(page) if wrappers.is_content(p, "body/article")]
    assert "Text" not in found if away else found == ["T", "Text", "More"]


def test_references_end_at_tags():
    assert [
        t for _, t in wrappers.blocks("<p>&am<b>p;</b> &<i>lt;</i> &amp;lt; &lt<b>x</b></p>")
    ] == ["&amp; &lt; &lt; <x"]


def test_many_structures_fold_in_levels(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FOLD", 3)
    pages = [
        (
            i, f"http://h{i % 2}.org/",
            f"<article><h1>Head</h1>{''.join(f'<div class=x{j}>{i} {j}</div>' for j in range(12) if i >> j & 1)}<p>By us</p></article>",
        )
        for i in range(1, 60)
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(frame).collect()}
    assert got == {i: "\n".join(f"{i} {j}" for j in range(12) if i >> j & 1) for i, _, _ in pages}


def test_without_the_wrapper_the_template_stays(spark, monkeypatch):
    pages = [
        (i, "http://h.org/", f"<article><h1>Head</h1><p>Story {i}</p><p>Read on</p><div>By us</div></article>") for i in range(5)
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.extract_text(frame).collect()} == {f"Story {i}\nRead on" for i in range(5)}
    known = wrappers.infer_wrappers(frame)
    empty = known.withColumns({"wrapper": F.lit("[]"), "constant": F.lit(None).cast("string")})
    monkeypatch.setattr(wrappers, "infer_wrappers", lambda *a: empty)
    got = {r["text"] for r in wrappers.extract_text(frame).collect()}
    assert got == {f"Head\nStory {i}\nRead on\nBy us" for i in range(5)}


def test_two_pages_are_no_evidence_and_prose_stays(spark):
    same = "<p>The bank rate is 4%.</p>"
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>story {i} goes on for long</p>{same}<h2>Rates</h2></article></body>"
    rows = [(i, "http://two.org/", page(i)) for i in range(2)] + [(i, "http://many.org/", page(i)) for i in range(10, 20)]
    for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        want = [f"Title {r['page_id']}", f"story {r['page_id']} goes on for long", "The bank rate is 4%."]
        assert r["text"].split("\n") == want + ["Rates"] * (r["page_id"] < 2)


def test_statistics_of_the_wrapper_find_the_content_without_tags_and_names(spark, data_dir, monkeypatch):
    """No tag and no class word says anything here: pages of divs with made-up classes."""
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    want = {r["page_id"]: r["text"] for r in wrappers.extract_text(pages).collect()}
    told = "article nav footer aside header main form".split()

    def bare(page: str) -> str:
        for i, tag in enumerate(told):
            page = re.sub(rf"</{tag}>", "</div>", re.sub(rf"<{tag}\b[^>]*>", f"<div class=z{'abcdefg'[i]}>", page))
        return re.sub(r'class="([a-z-]+)"', lambda m: "class=q" + m[1].replace("-", "q") + "q", page)

    blank = spark.createDataFrame([(r["page_id"], r["url"], bare(r["html"])) for r in pages.collect()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(blank).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    # Without the statistics of the article's slots, other slots are taken for the content, and the pages follow.
    known = wrappers.infer_wrappers(blank)
    less = known.withColumn("slots", F.regexp_replace("slots", r'("path":"[^"]*div\.za[^"]*","chars":)\d+', "$10"))
    monkeypatch.setattr(wrappers, "infer_wrappers", lambda *a: less)
    other = {r["page_id"]: r["text"] for r in wrappers.extract_text(blank).collect()}
    assert sum(other[i] != want[i] for i in want) >= 0.9 * len(want)


def test_wrappers_fold_repeats_and_options():
    a, b = wrappers.repeats(["h", "p", "p", "p", "f"]), wrappers.repeats(["h", "d", "p", "f"])
    assert wrappers.show(a) == "(h) (p)+ (f)" and wrappers.show(wrappers.align(a, b)) == "(h) (d)? (p)+ (f)"
    assert wrappers.show(wrappers.repeats(["dt", "dd", "dt", "dd"])) == "(dt dd)+"


def test_the_wrapper_decides_what_is_template(spark):
    def page(i: int, box: str = "", kind: str = "x") -> str:
        return f'<body><article><h1>Site name</h1><p>First {i}</p><p>Read on</p><p>Last {i}</p>{box}<div class="{kind}">By the staff</div></article></body>'

    rows = [(i, "http://a.org/", page(i, "<table><tr><td>Score</td></tr></table>" if i == 2 else "")) for i in range(6)]
    rows += [(10 + i, "http://b.org/", page(7)) for i in range(6)] + [
        (20, "http://c.org/", page(8)), *((30 + i, "http://d.org/", page(i, kind="y" if i % 2 else "x")) for i in range(8)),
    ]
    got = {
        r["page_id"]: r["text"].split("\n")
        for r in wrappers.extract_text(
            spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        ).collect()
    }
    for i in range(6):  # a slot's constant text goes, but not from the prose; one that a single page has stays
        assert got[i] == [f"First {i}", "Read on", f"Last {i}", *(["Score"] if i == 2 else [])]
    for i, n in (*((10 + i, 7) for i in range(6)), (20, 8)):  # copies of one page, and a single page, show no template
        assert got[i] == ["Site name", f"First {n}", "Read on", f"Last {n}", "By the staff"]
    for i in range(8):  # slots differ by class, and four pages are no evidence
        assert got[30 + i] == [f"First {i}", "Read on", f"Last {i}", "By the staff"]


def test_matches_skip_only_what_may_be_absent():
    wrapper = [
        [["a"], True, False], [["a"], False, False], [["b"], True, True], [["c"], False, False], [["b"], True, False],
    ]
    m = wrappers.Matcher(wrapper)
    of = lambda s: m.match(wrappers.repeats(list(s)))
    assert of("ac") == [1, 3] and of("abbc") == [1, 2, 3] and of("acb") == [1, 3, 4] and m.match(
        [[[x], False, False] for x in "aac"]
    ) == [0, 1, 3]
    assert of("ab") is None and of("bc") is None and of("acx") is None and wrappers.Matcher([]).match([]) == []


# ---------------------------------------------------------------- 6: mixing


def test_water_filling_is_feasible_and_met(spark, docs):
    got = mixing.mix_plan(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    per = got.groupby("source").agg(
        size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), biggest=("size", "max"),
    ).reset_index()
    left, targets = 1.5 * per["size"].sum(), dict.fromkeys(per["source"], 0.0)
    weight, caps = {
        s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(per["source"]))
    }, dict(zip(per["source"], 2.0 * per["size"], strict=True))
    open_ = set(targets)
    while open_:  # the plain loop: clamp what is over its cap, deal the rest again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= caps[s]}
        for s in over or open_:
            targets[s] = caps[s] if over else level * weight[s]
            left -= targets[s]
        open_ = open_ - over if over else set()
    assert all(abs(t - targets[s]) < 1e-6 for s, t in zip(per["source"], per["target"], strict=True))
    assert (
        abs(per["taken"] - per["target"]) <= per["biggest"] / 2 + 1e-6
    ).all() and (got["taken"] <= 2 * got["size"]).all()
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == int(
        (mixing.mix_plan(docs).agg(F.sum("copies")).first()[0])
    )


def test_rows_without_an_id_of_their_own_are_mixed(spark):
    rows = [(None, f"n{i} " * (3 + i % 5), "a") for i in range(60)] + [
        (i % 40, f"r{i} " * (2 + i % 7), "bc"[i % 2]) for i in range(120)
    ] + [(7, f"s{i} " * 4, "a") for i in range(20)]
    rows += [(1000 + i, f"t{i} " * 5, None) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.mix_plan(frame).select("source_size", "target", "taken", "size").toPandas()
    sizes = {s: sum(len(t.split()) for _, t, of in rows if of == s) for s in ("a", "b", "c", None)}
    assert len(set(sizes.values())) == 4
    of_plan = {s: plan[plan["source_size"] == n] for s, n in sizes.items()}
    mixed = mixing.mix_sources(frame).collect()
    for s, p in of_plan.items():
        words = sum(len(r["text"].split()) for r in mixed if r["source"] == s)
        assert words == p["taken"].sum() and abs(words - p["target"].iloc[0]) <= p["size"].max() / 2 + 1e-6
    assert any(r["doc_id"] is None for r in mixed) and max(
        Counter((r["doc_id"], r["text"]) for r in mixed).values()
    ) <= 2
    again = mixing.mix_sources(frame.repartition(2)).collect()
    assert Counter(
        (r["doc_id"], r["text"], r["source"]) for r in again
    ) == Counter((r["doc_id"], r["text"], r["source"]) for r in mixed)


# ---------------------------------------------------------------- 7: substrings


def test_family_of_passages_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = {
        i: " ".join(
            [
                *(f"u{x}" for x in rng.integers(0, 10**6, 30)), *([passage] if i % 3 else []),
                *(f"v{x}" for x in rng.integers(0, 10**6, 20))
            ]
        )
        for i in range(60)
    }
    rows |= {
        100: rows[4], 101: rows[4], 102: "too few words", 103: "too few words", 104: " ".join(["r"] * 40),
        105: " ".join(["r"] * 20),
    }
    got = {
        r["doc_id"]: r
        for r in substring.substring_dedup(
            spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        ).collect()
    }
    first: dict = {}
    for d in sorted(rows):
        w = rows[d].split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t in rows.items():
        w = t.split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        assert (got[d]["n_removed"], got[d]["kept_text"]) == (
            len(gone), " ".join(x for j, x in enumerate(w) if j not in gone),
        )


def test_windows_sent_before_are_remembered():
    seen = substring.Seen(most=8)
    h, g = np.array([1, 5, 9], np.uint64), np.array([1, 1, 1], np.int32)
    big = np.iinfo(np.int64).max
    assert (seen.known(h, g) == big).all()
    seen.add(h, g, np.array([30, 20, 10]))
    assert seen.known(h, g).tolist() == [30, 20, 10] and seen.known(h, g + 1).tolist() == [big] * 3
    seen.add(h[:1], g[:1], np.array([7]))
    assert seen.known(h, g).tolist() == [7, 20, 10]
    for i in range(10):
        seen.add(np.array([100 + i], np.uint64), g[:1], np.array([i]))
    assert len(seen.h) <= 8


def test_minimisers_and_filters_lose_nothing():
    h = WordHash().of([b"%d" % (i % 50) for i in range(200)])
    first, at, m = substring.minimisers(h, np.zeros(200, int), 13)
    assert len(first) == 188 and (at >= first).all() and (at <= first + 6).all() and (
        gram_hashes(h, 7, seed=21)[at] == m
    ).all()
    f = IdFilter(1000)
    f.add(np.arange(0, 2000, 2))
    assert f.maybe(np.arange(0, 2000, 2)).all() and f.maybe(np.arange(1, 2000, 2)).mean() < 0.05


# ---------------------------------------------------------------- 8: token counts


def greedy(word: bytes, pieces: set, longest: int) -> int:
    n = i = 0
    while i < len(word):
        i += next(k for k in range(min(longest, len(word) - i), 0, -1) if k == 1 or word[i : i + k] in pieces)
        n += 1
    return n


def test_counts_equal_naive_longest_match(spark, texts):
    pieces = set(tokencount.read_vocabulary(tokencount.VOCABULARY))
    longest = max(map(len, pieces))
    got = {
        r["doc_id"]: r
        for r in tokencount.token_counts(
            spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        ).collect()
    }
    for d, t in list(texts.items())[:60]:
        words = t.encode().split()
        assert (got[d]["n_words"], got[d]["n_tokens"]) == (
            len(words), sum(greedy(b" " + w, pieces, longest) for w in words),
        )


def test_automaton_on_tricky_pieces():
    pieces = [b"a", b"abcd", b"bcx", b"ab", b"cdab", b"dd"]
    auto = tokencount.Automaton(pieces)
    rng = np.random.default_rng(0)
    words = [bytes(rng.choice(list(b"abcdx"), rng.integers(1, 30))) for _ in range(500)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    got = auto.count(data, np.concatenate([[0], ends[:-1]]), ends)
    assert got.tolist() == [greedy(w, set(pieces), 4) for w in words]


# ---------------------------------------------------------------- 9: shards


def test_shares_are_even_and_little_moves(spark, docs):
    names = [f"s{i}" for i in range(20)]
    full, less = sharding.fill_table(names), sharding.fill_table(names[:-1])
    counts = np.bincount(full, minlength=20)
    assert counts.max() - counts.min() <= 1 and (full >= 0).all()
    stayed = full != 19
    assert (full[stayed] != less[stayed]).mean() < 0.1
    got = sharding.place(docs, 20).select("doc_id", "slot", "shard").collect()
    table = sharding.fill_table([f"shard-{i:05d}" for i in range(20)])
    assert all(r["shard"] == f"shard-{table[r['slot']]:05d}" for r in got) and len({r["shard"] for r in got}) == 20
    known = {r["doc_id"]: r["slot"] for r in got}
    assert all(
        slot == xxhash.xxh64_intdigest(str(d), 42) % 2**64 % sharding.SLOTS
        or slot == (xxhash.xxh64_intdigest(str(d), 42) - 2**64) % sharding.SLOTS for d, slot in known.items()
    )
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(names, 100)


# ---------------------------------------------------------------- 10: exact copies


def test_hot_groups_and_a_full_filter(spark):
    rows = [(i, "hot") for i in range(3000)] + [
        (5000 + i, f"t{i % 400}") for i in range(900)
    ] + [(9000, None), (9001, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = defaultdict(list)
    for d, t in rows:
        want[t or ""].append(d)
    for options in ({}, {"bits_per_row": 1, "max_blocks": 1}):
        got = exact.exact_groups(frame, **options).collect()
        assert {
            (r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got
        } == {(d, max(g), len(g), d == max(g)) for g in want.values() for d in g}
    assert exact.exact_dedup(frame).count() == len(want)


# ---------------------------------------------------------------- the pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, data_dir, docs, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mix", "shards"]
    at, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, data_dir).cache()
        frames[name] = at
        if name != "shards":
            assert at.columns == docs.columns
    ids = {n: [r["doc_id"] for r in f.select("doc_id").collect()] for n, f in frames.items()}
    groups = brute_groups({d: texts[d] for d in ids["quality"]}, 5, 80)
    assert set(ids["near_dedup"]) == {d for d, (_, root) in groups.items() if d == root}
    bench = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    bad = {
        r["doc_id"]
        for r in decontam.decontaminate(frames["near_dedup"], bench).filter("contaminated").select("doc_id").collect()
    }
    assert set(ids["decontamination"]) == set(ids["near_dedup"]) - bad
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(frames["decontamination"]).collect()}
    assert Counter(ids["mix"]) == Counter({d: c for d, c in plan.items() if c})
    assert Counter(ids["shards"]) == Counter(ids["mix"]) == Counter(
        r["doc_id"] for r in corpus_pipeline.run(spark, data_dir).select("doc_id").collect()
    )
    assert frames["shards"].columns == [*docs.columns, "slot", "shard"]
