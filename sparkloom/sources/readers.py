"""Readers of text formats into tables. Malformed input is an error that says
what is wrong, unless a reader's name says that it is tolerant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.scoring import ALPHABET

STATE_COLUMNS = ["Node", "Site", "State", *(f"p_{a}" for a in ALPHABET)]


def require(df: DataFrame, problem: Column, message: str) -> DataFrame:
    """``df``, or an error with ``message`` as soon as a row has the problem;
    checked where the row is read, without a pass of its own."""
    return df.where(F.when(problem, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def facts(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV table with a header and a fixed schema, cut to ``columns``."""
    df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def states(spark: SparkSession, path: str, nodes: DataFrame | None = None, tolerant: bool = False) -> DataFrame:
    """(node, position, state, probs) of a tab-separated state file with
    comment lines and a header of fixed order. With ``nodes`` (node) only
    theirs are kept. ``tolerant`` drops malformed rows instead of failing."""
    header = [r["value"] for r in spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").startswith("Node\t")).select("value").limit(1).collect()]
    if not header or header[0].split("\t") != STATE_COLUMNS:
        raise ValueError("the columns are not Node, Site, State and the probabilities in order")
    schema = ", ".join(f"`{c}` {'string' if c in ('Node', 'State') else 'int' if c == 'Site' else 'double'}" for c in STATE_COLUMNS)
    df = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("header", True).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").csv(path)
    if nodes is not None:
        df = df.join(nodes.select(F.col("node").alias("Node")).distinct(), "Node", "left_semi")
    return df.select(F.col("Node").alias("node"), F.col("Site").alias("position"), F.col("State").alias("state"), F.array(*STATE_COLUMNS[3:]).alias("probs"))


def fasta(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """(id, header, sequence) of FASTA records, split at every '>' that starts
    a line, so a large file is read by many tasks. A record without a name and
    a sequence before the first header are errors; white space inside
    sequences goes. ``places`` adds ``place``, ordered as in the files."""
    file = F.col("_metadata.file_path")
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", file.alias("file"), F.struct(file, F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    # only a file's first record keeps its '>'; blank lines may stand before it
    named = F.col("value").startswith(">") | (F.trim(F.regexp_replace("value", r"\s", "")) == "")
    headless = [r["file"] for r in raw.groupBy("file").agg(F.count_if(named).alias("n")).where("n = 0").select("file").limit(3).collect()]
    if headless:
        raise ValueError(f"a sequence before the first header in {', '.join(headless)}")
    raw = raw.withColumn("v", F.regexp_replace("value", "^>", "")).where(F.col("value").startswith(">") | (F.regexp_replace("v", r"\s", "") != ""))
    part = F.split("v", "\r?\n", 2)
    rows = raw.select(F.trim(part[0]).alias("header"), F.regexp_replace(F.coalesce(F.get(part, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"), "place")
    rows = require(rows, F.col("header") == "", "a FASTA record without a name")
    return rows.select(F.split("header", r"\s+")[0].alias("id"), "header", "sequence", *(["place"] if places else []))


def last_wins(records: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """One record per id: of repeated ids the last, by ``place`` (see
    ``fasta``), so files in order of name, records as they stand."""
    rest = [c for c in records.columns if c not in (key, place)]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_r")).select(key, "_r.*")


def alignment(records: DataFrame) -> DataFrame:
    """(leaf, position, residue) of records of one length with unique ids, an
    error otherwise; positions from 1, residues in upper case."""
    n = records.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min(F.length("sequence")).alias("lo"), F.max(F.length("sequence")).alias("hi")).first()
    if not n["n"]:
        raise ValueError("an empty alignment")
    if n["ids"] < n["n"]:
        raise ValueError("an alignment with repeated ids")
    if n["lo"] != n["hi"]:
        raise ValueError(f"a ragged alignment: lengths from {n['lo']} to {n['hi']}")
    return records.select(F.col("id").alias("leaf"), F.posexplode(F.split(F.upper("sequence"), "")).alias("p", "residue")).where("residue <> ''").select("leaf", (F.col("p") + 1).alias("position"), "residue")


def header_fields(headers: DataFrame, header: str = "header") -> DataFrame:
    """``headers`` with accession, name, organism, taxon (OX digits, else the
    organism), gene of a sequence database's header."""
    h = F.col(header)
    got = lambda p: F.nullif(F.regexp_extract(h, p, 1), F.lit(""))
    ident = F.split(h, r"\s+")[0]
    bar = F.split(ident, r"\|")
    organism = F.trim(got(r"OS=(.*?)(?:\s+[A-Z]{2}=|$)"))
    return headers.withColumns({
        "accession": F.when(F.size(bar) >= 3, bar[1]).otherwise(ident),
        "name": F.trim(got(r"^\S+\s+(.*?)(?:\s+[A-Z]{2}=|$)")), "organism": organism,
        "taxon": F.coalesce(got(r"OX=(\d+)"), organism), "gene": got(r"GN=(\S+)"),
    })


def environmental(name: Column) -> Column:
    """Whether a name marks an environmental sample."""
    return F.coalesce(name.rlike(r"(?i)metagenome|environmental\s+sample|uncultured|unidentified"), F.lit(False))


def category(name: Column, rules: list[tuple[str, str]], other: str = "Other") -> Column:
    """The first category whose pattern a name matches."""
    out = F.lit(other)
    for pattern, label in reversed(rules):
        out = F.when(F.lower(name).rlike(pattern), label).otherwise(out)
    return out


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, member) of a cluster listing: '>Cluster k' lines, then one
    line per member with '>id...'. Clusters are split at their headers."""
    raw = spark.read.option("lineSep", "\n>Cluster").text(path).select(F.regexp_replace("value", r"^\s*>Cluster", "").alias("v"))
    rows = raw.select(F.regexp_extract("v", r"^\s*(\d+)", 1).cast("long").alias("cluster"), F.explode(F.regexp_extract_all("v", F.lit(r">(\S+?)(?:\.\.\.|\s|$)"), 1)).alias("member"))
    return rows.where("cluster is not null")


def newick_nodes(text: str) -> list[tuple[int, int | None, str, float | None, int]]:
    """(node, parent, name, length, ord) of one tree; nodes are numbered in
    preorder. Comments in brackets go, quoted names stay whole; unbalanced
    brackets are an error."""
    out: list[list] = [[0, None, "", None, 0]]
    here, fresh, i, kids = 0, True, 0, {0: 0}
    text = text.strip().rstrip(";").strip()
    if not text:
        raise ValueError("an empty tree")
    while i < len(text):
        c = text[i]
        if c == "[":
            i = text.index("]", i) + 1
            continue
        if c in "(,":
            if c == "(" and not fresh:
                raise ValueError(f"unexpected bracket at {i}")
            parent = here if c == "(" else out[here][1]
            if parent is None:
                raise ValueError(f"a branch outside the tree at {i}")
            out.append([len(out), parent, "", None, kids.get(parent, 0)])
            kids[parent] = kids.get(parent, 0) + 1
            here, fresh = len(out) - 1, True
        elif c == ")":
            if out[here][1] is None:
                raise ValueError(f"unbalanced bracket at {i}")
            here, fresh = out[here][1], False
        elif c == ":":
            j = i + 1
            while j < len(text) and text[j] not in "(),:;[":
                j += 1
            out[here][3] = float(text[i + 1 : j])
            i = j
            continue
        elif c in "'\"":
            j = text.index(c, i + 1)
            out[here][2], fresh, i = text[i + 1 : j], False, j
        elif not c.isspace():
            j = i
            while j < len(text) and text[j] not in "(),:;[":
                j += 1
            out[here][2], fresh, i = text[i:j].strip(), False, j
            continue
        i += 1
    if here:
        raise ValueError("unbalanced brackets")
    return [tuple(x) for x in out]


def trees(texts: DataFrame, key: str, text: str, tolerant: bool = False) -> DataFrame:
    """(key, node, parent, name, length, ord): nodes of every tree of
    ``texts``, a row each. ``tolerant`` leaves out trees that can't be read."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text], strict=True):
                try:
                    rows += [(k, *n) for n in newick_nodes(t or "")]
                except ValueError:
                    if not tolerant:
                        raise
            yield pd.DataFrame(rows, columns=["k", "node", "parent", "name", "length", "ord"]).astype({"parent": "Int64", "length": "Float64"})

    k = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"k {k}, node long, parent long, name string, length double, ord int").withColumnRenamed("k", key)


def tree_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tree, value): a file of one tree per line, numbered by position."""
    raw = spark.read.text(path).where(F.trim("value") != "").withColumn("tree", F.monotonically_increasing_id())
    return raw.select("tree", "value")


def leaf_names(text: Column) -> Column:
    """The leaf names of a tree's text."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\[[^\]]*\]", ""), F.lit(r"[(,]\s*([^(),:;\s]+)"), 1)


def losses(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, survivors): the losses of reconciled gene trees, one XML
    file each. A loss is a clade named 'loss'; ``survivors`` are the sorted
    leaf names of its first sibling, which say on which branch it lies, and
    ``kind`` is TL if the parent's events have a transfer, else SL. Losses
    without a surviving sibling are left out. A file without losses has one
    row with kind '', one that can't be read has kind null."""
    import pandas as pd

    def run(frames):
        import xml.etree.ElementTree as ET

        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        under = lambda e, kind: [c for c in e if tag(c) == kind]
        named = lambda e: next((n.text for n in under(e, "name")), None)

        def survivors(top) -> list[str]:
            out, todo = [], [top]
            while todo:
                e = todo.pop()
                if named(e) != "loss":
                    below = under(e, "clade")
                    todo += below
                    if not below and named(e) not in (None, "NULL"):
                        out.append(named(e))
            return sorted(out)

        def events(text: str) -> list[tuple[str, list[str]]]:
            out = []
            for tree in [e for e in ET.fromstring(text).iter() if tag(e) == "recGeneTree"][:1]:
                for parent in tree.iter():
                    clades = under(parent, "clade")
                    for lost in [c for c in clades if named(c) == "loss"]:
                        left = survivors(sibling) if (sibling := next((c for c in clades if c is not lost), None)) is not None else []
                        happened = {tag(v) for r in under(parent, "eventsRec")[:1] for v in r}
                        if left:
                            out.append(("TL" if happened & {"transferBack", "branchingOut"} else "SL", left))
            return out or [("", [])]

        for f in frames:
            rows = []
            for name, text in zip(f["file"], f["value"], strict=True):
                try:
                    rows += [(name, *x) for x in events(text)]
                except ET.ParseError:
                    rows.append((name, None, None))
            yield pd.DataFrame(rows, columns=["file", "kind", "survivors"])

    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), "value")
    return raw.mapInPandas(run, "file string, kind string, survivors array<string>")


def loss_frequencies(found: DataFrame, branches: DataFrame) -> DataFrame:
    """(node, speciation_losses, transfer_losses, total_losses and a
    ``_frequency`` of each): losses of ``losses`` on the branches (node,
    survivors: sorted leaf names), over the files that could be read; branches
    without a loss have no row. Losses on no branch are left out."""
    parsed = found.where("kind is not null").agg(F.count_distinct("file").alias("_files"))
    n = found.where("kind <> ''").groupBy("survivors").agg(F.count_if(F.col("kind") == "SL").alias("speciation_losses"), F.count_if(F.col("kind") == "TL").alias("transfer_losses"))
    rows = branches.select("node", "survivors").join(n, "survivors").withColumn("total_losses", F.col("speciation_losses") + F.col("transfer_losses")).crossJoin(F.broadcast(parsed))
    kinds = ("speciation_losses", "transfer_losses", "total_losses")
    return rows.select("node", *kinds, *((F.col(c) / F.col("_files")).alias(f"{c.removesuffix('es')}_frequency") for c in kinds))


def key_values(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(sample, a column per key): 'K:V' lines of one file per sample; a
    missing key is 0."""
    raw = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("sample"), F.split("value", ":").alias("kv")).where(F.size("kv") == 2)
    return raw.groupBy("sample").agg(*(F.coalesce(F.sum(F.when(F.trim(F.col("kv")[0]) == k, F.trim(F.col("kv")[1]).cast("double"))), F.lit(0.0)).alias(k) for k in keys))


def event_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(event, n, mean, deviation, percent) over the samples."""
    rows = samples.unpivot(["sample"], keys, "event", "value").groupBy("event").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    total = rows.agg(F.sum("mean").alias("_t"))
    return rows.crossJoin(F.broadcast(total)).select("event", "n", "mean", "deviation", (100 * F.col("mean") / F.nullif(F.col("_t"), F.lit(0.0))).alias("percent"))


def fields(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """White-space separated columns; lines with fewer fields and comments are left out."""
    x = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") >= len(schema))
    return x.select(*(F.col("x")[i].try_cast(t).alias(c) for i, (c, t) in enumerate(schema.items())))


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, parameters): a header line and its first row, as a map."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.split(F.trim("value"), "\r?\n").alias("l"))
    cells = lambda i: F.split(F.trim(F.col("l")[i]), r"[\s,]+")
    return raw.where((F.size("l") > 1) & (F.size(cells(0)) == F.size(cells(1)))).select("file", F.map_from_arrays(cells(0), cells(1)).alias("parameters"))


def rates(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(position, rate) of a table whose columns are Site or Position, and
    Rate, in any case; an error if one is missing."""
    df = spark.read.option("header", True).option("sep", sep).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(path)
    named = {c.strip().lower(): c for c in df.columns}
    place = named.get("site") or named.get("position")
    if not place or "rate" not in named:
        raise ValueError(f"no site and rate among {df.columns}")
    return df.select(F.col(f"`{place}`").cast("int").alias("position"), F.col(f"`{named['rate']}`").cast("double").alias("rate"))


def species_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-species events: CSV with a header and spaces after commas."""
    return spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def layers(spark: SparkSession, path: str, schema: str, skip: tuple[int, ...] = (1,)) -> DataFrame:
    """The union of CSV files whose folder ends in a number: ``layer``, and
    all columns; layers in ``skip`` are left out."""
    df = spark.read.schema(schema).option("header", True).csv(path).withColumn("layer", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)/[^/]*$", 1).try_cast("int"))
    return df.where(F.col("layer").isNotNull() & ~F.col("layer").isin(*skip))


def domain_hits(spark: SparkSession, path: str) -> DataFrame:
    """(target, query, score, start, end, best) of a domain table with 22
    columns or more; ``best`` marks a target's hit of highest score."""
    x = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") >= 20)
    rows = x.select(F.col("x")[0].alias("target"), F.col("x")[3].alias("query"), F.col("x")[13].try_cast("double").alias("score"), F.col("x")[19].try_cast("int").alias("start"), F.get("x", F.lit(20)).try_cast("int").alias("end"))
    return rows.withColumn("best", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "start", "query")) == 1)


def alpha_carbons(spark: SparkSession, path: str) -> DataFrame:
    """(file, chain, residue, name, x, y, z) of the alpha carbons of the first
    model of fixed-column structure files; of alternates the first. Lines keep
    their order inside a file, which is read whole."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.substring_index("value", "\nENDMDL", 1).alias("v"))
    line = raw.select("file", F.posexplode(F.split("v", "\r?\n")).alias("i", "l")).where(F.col("l").startswith("ATOM") & (F.trim(F.substring("l", 13, 4)) == "CA"))
    cut = lambda a, n: F.trim(F.substring("l", a, n))
    rows = line.select("file", "i", cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("residue"), cut(18, 3).alias("name"), *(cut(a, 8).cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))))
    return rows.groupBy("file", "chain", "residue").agg(F.min_by(F.struct("name", "x", "y", "z"), "i").alias("r")).select("file", "chain", "residue", "r.*")


def replicates(spark: SparkSession, path: str, columns: list[str], expected: int | None = None) -> DataFrame:
    """A folder of Parquet parts by ``replicate``; missing columns are an
    error, as is, with ``expected``, a replicate of another number of rows."""
    df = spark.read.parquet(path)
    gone = [c for c in [*columns, "replicate"] if c not in df.columns]
    if gone:
        raise ValueError(f"no columns {gone}")
    if expected is not None:
        bad = df.groupBy("replicate").count().where(F.col("count") != expected).orderBy("replicate").limit(3).collect()
        if bad:
            raise ValueError(f"replicates of another length: {[(r['replicate'], r['count']) for r in bad]}")
    return df.select("replicate", *columns)


def settings(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON object (or several) of any layout, one row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def taxon_guard(leaves: DataFrame, sequences: DataFrame, allow_extra: bool = False) -> None:
    """An error if leaf names or ids repeat, a leaf has no sequence, or (unless
    allowed) a sequence has no leaf."""
    for df, c in ((leaves, "name"), (sequences, "id")):
        twice = [r[c] for r in df.groupBy(c).count().where("count > 1").orderBy(c).limit(3).collect()]
        if twice:
            raise ValueError(f"repeated {c}: {twice}")
    a, b = leaves.select(F.col("name").alias("x")), sequences.select(F.col("id").alias("x"))
    for one, other, what in ((a, b, "leaves without a sequence"), (b, a, "sequences without a leaf")):
        gone = [r["x"] for r in one.join(other, "x", "left_anti").orderBy("x").limit(3).collect()]
        if gone and not (allow_extra and one is b):
            raise ValueError(f"{what}: {gone}")


def run_records(spark: SparkSession, path: str, base: str = "/") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, merged, staged, progress), as ``provenance.invocations`` takes
    them, of all runs below ``path``: npz/rep_*.npz, run_manifest.json and
    provenance.json (``replicates``) and logs/progress.jsonl. Relative sources
    start from ``base``. A record that is no JSON says nothing."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/+", "/"), "/+$", "")
    file = plain(F.col("_metadata.file_path"))
    folder = lambda c, up: F.regexp_replace(c, r"(/[^/]*){%d}$" % up, "")
    found = lambda name: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)

    # only names are read of the replicates; Spark lists no empty files
    listed = found("rep_*.npz").format("binaryFile").load(path).select(plain(F.col("path")).alias("f")).where("f like '%/npz/%'")
    files = listed.select(folder(F.col("f"), 2).alias("run"), F.substring_index("f", "/", -1).alias("file"))

    def entries(name: str, fields: str) -> DataFrame:
        whole = found(name).text(path, wholetext=True).select(folder(file, 1).alias("run"), F.from_json("value", f"replicates array<struct<{fields}>>").alias("_"))
        return whole.select("run", F.explode("_.replicates").alias("e")).select("run", "e.*")

    merged = entries("run_manifest.json", "merged_index: bigint, source: string")
    source = F.when(F.col("source").startswith("/"), F.col("source")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "source"))
    merged = merged.select("run", "merged_index", folder(source, 2).alias("source_run"), F.substring_index("source", "/", -1).alias("source_file"))
    staged = entries("provenance.json", "rep_id: string, invocation: string")
    lines = found("progress.jsonl").text(path).select(folder(file, 2).alias("run"), F.from_json("value", "replicate bigint, batch string").alias("e"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    return files, merged, staged, lines.select("run", "e.*", "place")
