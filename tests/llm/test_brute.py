"""Whole results of the operators and of the pipeline against plain versions."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import brute  # noqa: E402

from sparkloom.llm import chat, decontaminate, html_extract, packing, quality, queries, rollups, secret_scan, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * i % 977}" for i in range(9000))
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "é ü " * 40 + "\n" + "é ü " * 40), (7, "PASSWORD = 'aaaaaaaaaaaa' token:short AKIA" + "Z9" * 9 + " " + "0a" * 9 + "g secret: " + "x" * 11), (8, "same line of words here\n" * 30), (9, "# $ % " * 60)]


@pytest.fixture(scope="module")
def rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [*HARD, *((r["doc_id"] + 100, r["text"]) for r in real)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With repeated rows and columns that bear the operators' own names."""
    own = "kept string, n_words string, leaks string, secrets string, score string, h string, sequence_id string"
    return spark.createDataFrame([(*r, *"kwlzshq") for r in [*rows, rows[0], rows[7]]], f"doc_id long, text string, {own}").cache()


def test_quality(docs):
    out = quality.quality_rules(docs).collect()
    assert len(out) == docs.count() and all(r["score"] == "s" for r in out)
    for r in out:
        want = brute.measures(r["text"])
        assert {k: r[k] for k in want} == want, r["doc_id"]


def test_secrets(docs):
    names = ("assign", "access", "hex")
    for r in secret_scan.secret_spans(docs).collect():
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"] if s["kind"] in names) == brute.base_secrets(r["text"])


def test_pieces_and_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(queries.vocabulary())
    rows = [*rows, (50, " " * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(packing.pieces(df, queries.vocabulary())).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["piece"] == len(got[r["doc_id"]])
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert got == {d: brute.pieces([*slow.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows}
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [a for a, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(places) <= 1.01 * -(-sum(r["length"] for r in out) // 1024) + 1


@pytest.mark.parametrize("times", [1, 1000, 1_000_000])
def test_program_places_the_pieces(times):
    rng = np.random.default_rng(3)
    for mean in (5, 6):
        base = Counter(np.clip(np.exp(rng.normal(mean, 0.8, 3000)), 1, 1024).astype(int).tolist())
        need = Counter({x: n * times for x, n in base.items()})
        placed, left = packing.programme(need)
        assert left.total() <= len(base)
        made = Counter(left)
        for config, n in placed.items():
            assert sum(config) <= 1024
            for x in config:
                made[x] += n
        assert made == need
        used = sum(n for _, n in packing.plan(need))
        assert used <= 1.012 * sum(x * n for x, n in need.items()) / 1024 + 1
        assert len(placed) < 20_000


def test_leaks_both_ways(spark, docs, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    cut = " ".join(items[0][1].split()[: len(items[0][1].split()) * 3 // 4])
    mixed = [*rows, (60, "Some words before. " + items[1][1] + " and after"), (61, cut), (62, " ".join(reversed(items[2][1].split())))]
    table = spark.createDataFrame([*items, (900, "solo"), (901, ""), (902, None)], "item_id long, text string")
    want = {d: brute.leaks(t, [*items, (900, "solo")]) for d, t in mixed}
    assert sum(map(bool, want.values())) >= 2
    out = decontaminate.leaks(spark.createDataFrame(mixed, "doc_id long, text string"), table).collect()
    got = {r["doc_id"]: {x["item_id"]: x["score"] for x in r["leaks"]} for r in out}
    assert {d: set(x) for d, x in got.items()} == {d: set(x) for d, x in want.items()}
    assert all(abs(got[d][i] - s) < 1e-6 for d, x in want.items() for i, s in x.items())


def test_scores_do_not_depend_on_the_split(spark, monkeypatch, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for size in (4_000_000, 3_000):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        found.append({(r["doc_id"], x["item_id"]) for r in decontaminate.leaks(df, items).collect() for x in r["leaks"]})
    assert found[0] and found[0] == found[1]
    texts = [(r["item_id"], r["text"].encode()) for r in items.collect()]
    whole, part = decontaminate.build(texts), decontaminate.build(texts[:7], decontaminate.corpus_of(texts))
    top = dict(zip(whole.terms.tolist(), whole.postings, strict=True))
    for x, (at, score, _) in zip(part.terms.tolist(), part.postings, strict=True):
        full = dict(zip((whole.ids[i] for i in top[x][0]), top[x][1], strict=True))
        assert all(abs(full[part.ids[i]] - s) < 1e-12 for i, s in zip(at, score, strict=True))


def test_conversations(spark):
    real = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = [(None, 0, "user", "x"), (500, 1, None, None), (500, 0, "assistant", ""), (500, 2, "assistant", "a < b\\ " * 50_000)]
    logs = real.unionByName(spark.createDataFrame([*queries.HARD_CASE, *extra], real.schema))
    want = {}
    for r in sorted(logs.collect(), key=lambda r: r["turn"]):
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    out = chat.digests(chat.format_turns(chat.as_events(logs))).collect()
    assert len(out) == len(want)
    for r in out:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a}\n{b}\n" for a, b in turns), loss)]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha[0], len(loss), sha[1])


def test_html_hard_pages(spark):
    deep = "<div>" * 3000 + "<p>" + "far down, " * 9 + "</p>"
    pages = {
        deep: "far down, " * 8 + "far down,",
        "<body><p>hello <a href=\"x>link</a> world, and more</p>": "hello link world, and more",
        "<main><p>a &lt; b &#233;\n\t c</p><script>var x = '<p>no</p>'</script><ul><li>one, two<li>three</ul></main>": "a < b é c\none, two\nthree",
        "": "",
        None: "",
        "no tags, only text": "no tags, only text",
    }
    rows = [(i, f"u{i}", p, "own") for i, p in enumerate(pages)]
    out = html_extract.main_text(spark.createDataFrame([*rows, rows[2]], "page_id long, url string, html string, text string")).collect()
    assert len(out) == 7 and {r["page_id"]: r["text"] for r in out} == dict(enumerate(pages.values()))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = {r["doc_id"]: r for r in queries.queries()["op8_toxicity"](spark, sf).collect()}
    assert len(out) == docs.count()
    truth = [(out[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    pos, neg = [s for s, y in truth if y], [s for s, y in truth if not y]
    assert pos and neg
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.9
    assert np.mean([(s >= 0.5) == bool(y) for s, y in truth]) > 0.9


def test_toxicity_spans_and_bounds(spark):
    rows = [(i, f"é plain words {i}. more of it" + ("! you idiot here" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    small = toxicity.labelled_sample(df, df, most_bytes=3000)
    assert 0 < small.count() < 150
    model = toxicity.fit(toxicity.labelled_sample(df, df))
    for r in toxicity.score(df, model).where("doc_id < 40").collect():
        assert [r["text"][x["start"] : x["end"]] for x in r["offending"]] == ([" you idiot here"] if r["doc_id"] % 4 == 0 else [])


def test_token_counts(spark, tmp_path):
    sf, encode = SF, packing.encoder(queries.vocabulary())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        first.setdefault((r["source"], r["lang"], r["text"] or ""), r["doc_id"])
    want = []
    for r in docs:
        if first[r["source"], r["lang"], r["text"] or ""] == r["doc_id"]:
            t = r["text"] or ""
            want += [(r["source"], r["lang"], "words", 1, len(brute.words(t))), (r["source"], r["lang"], "byte_bpe_50k", 1, len(encode(rollups.tidy(t))))]
    got = {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in queries.queries()["op9_token_counts"](spark, sf).collect()}
    assert got == brute.totals(want)
    kept = rollups.Rollup(spark, f"file://{tmp_path}/r")
    add = lambda *x: spark.createDataFrame([x], rollups.SCHEMA)
    assert kept.totals().count() == 0 and kept.compact() == 0
    assert kept.commit("a", add("s", None, "v", 1, 10)) and kept.commit("b", add("s", "en", "v", 2, 7)) and not kept.commit("a", add("s", None, "v", 9, 9))
    assert kept.compact() == 2 and not kept.commit("b", add("s", "en", "v", 2, 7)) and kept.commit("c", add("s", "en", "v", -2, -7))
    other = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert not other._publish(add("s", "en", "v", 5, 5), other._folder("c"))
    for _ in range(2):
        assert [tuple(r) for r in kept.totals().collect()] == [("s", None, "v", 1, 10)]
        kept.compact()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c", None)], none.schema)
    assert secret_scan.secret_spans(none).count() == html_extract.main_text(none.drop("text")).count() == 0
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(some, items).first()["leaks"] == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(none, labels))
    assert toxicity.score(none, model).count() == 0 and 0 <= toxicity.score(some, model).first()["score"] <= 1
    assert rollups.token_counts(none.select("doc_id", "text"), queries.vocabulary()).count() == 0
    log = spark.createDataFrame([], "conv_id long, turn long, seq long, kind string, role string, text string")
    assert chat.digests(chat.format_turns(log)).count() == 0


def masked(text):
    spans = sorted((a, b) for _, a, b in secret_scan.scan([text.encode()])[0])
    out, at = "", 0
    for a, b in spans:
        if a > at or not out and a == at == 0 or a == at and not out.endswith("[SECRET]"):
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark, tmp_path, rows):
    """run() over a table with hard rows and clashing columns."""
    from tokenizers import Tokenizer

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    full = spark.read.parquet(f"{SF}/documents.parquet")
    near = rows[-1][1].split()
    rows = [*rows, (5001, " ".join([*near[:3], *near[4:]])), (5002, LONG + " secret = " + "x1" * 12)]
    table = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "mine", "own", "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, leaks string, `a.b` string")
    assert set(full.columns) <= set(table.columns)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(d, t) for d, t in rows if brute.measures(t)["kept"]]
    first = brute.nearest_ids(kept, 5, 80, 100)
    alone = [(d, t) for d, t in kept if first[d] == d]
    clean = [(d, masked(t)) for d, t in alone if not brute.leaks(t, items)]
    assert len(rows) > len(kept) > len(alone) > len(clean) > 0
    stage = corpus_pipeline.keep_quality(spark, table, str(tmp_path))
    assert stage.columns == table.columns and {(r["kept"], r["leaks"]) for r in stage.collect()} == {("mine", "own")}
    slow = Tokenizer.from_file(queries.vocabulary())
    got = defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert got == {d: brute.pieces([*slow.encode(t, add_special_tokens=False).ids, 2]) for d, t in clean}


def test_stages_on_hard_tables(spark, tmp_path):
    """Rows without an id or a text, repeated rows, dotted names, no rows."""
    spark.createDataFrame([(1, "what is the name of the oldest tree in the park. it is the old oak by the gate")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(None, good + " alone here"), (None, None), (4, good), (4, good), (7, good), (8, " ".join(f"other{i}" for i in range(60)) + " token=abcdefghijkl12"), (None, good + " alone here")]
    table = spark.createDataFrame([(d, t, len(t or ""), "x", "y") for d, t in rows], "doc_id long, text string, n_chars int, `a.b` string, Text_ string")
    kept = [0, 2, 3, 4, 5, 6]
    out = corpus_pipeline.keep_quality(spark, table, str(tmp_path))
    assert sorted(map(repr, out.collect())) == sorted(repr(r) for i, r in enumerate(table.collect()) if i in kept)
    near = corpus_pipeline.drop_near_copies(spark, out, str(tmp_path))
    assert sorted(repr(r["doc_id"]) for r in near.collect()) == ["4", "4", "8", "None", "None"]
    clean = corpus_pipeline.mask_secrets(spark, corpus_pipeline.drop_leaks(spark, near, str(tmp_path)), str(tmp_path))
    assert clean.schema == table.schema and clean.count() == 5
    assert all(r["n_chars"] == len(r["text"]) and r["a.b"] == "x" and "abcdefghijkl12" not in r["text"] for r in clean.collect())
    assert corpus_pipeline.pack_sequences(spark, clean, str(tmp_path)).count() == 5
    none = table.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, none, str(tmp_path))
        assert none.schema == table.schema and none.count() == 0
    assert corpus_pipeline.pack_sequences(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("shape", ["sf0.001", "sf0.01", "uniform", "narrow", "triplets", "exponential", "lognormal", "long"])
def test_no_more_sequences_than_best_fit(spark, shape):
    """The plan against best fit of all pieces, and by how much it may lie above the bound of length."""
    rng = np.random.default_rng(7)
    if shape.startswith("sf"):
        docs = spark.read.parquet(f"/root/testdata/{shape}/documents.parquet")
        need = Counter(r["length"] for r in packing.pieces(docs, queries.vocabulary()).collect())
    else:
        a, b = rng.integers(260, 420, 700), rng.integers(260, 420, 700)
        made = {"uniform": rng.uniform(200, 600, 2000), "narrow": rng.uniform(300, 600, 2000), "triplets": np.concatenate([a, b, 1024 - a - b]), "exponential": rng.exponential(300, 3000), "lognormal": rng.lognormal(5.5, 0.8, 3000), "long": rng.uniform(500, 1024, 2000)}
        need = Counter(np.clip(made[shape], 1, 1024).astype(int).tolist())
    used, plainly = sum(n for _, n in packing.plan(need)), packing.best_fit(need, 1024).total()
    assert used <= plainly
    assert shape not in ("uniform", "narrow", "triplets") or used < 0.99 * plainly
