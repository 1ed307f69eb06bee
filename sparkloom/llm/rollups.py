"""Operator 9, token counts: delta-maintained rollups.

Signed changes (inserts, deletes, revised counts) update additive totals by
source, language and tokenizer version. A batch is committed once: its
folder, named by its id, is complete or absent, and a repeated id is skipped.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel
from .packing import encoder

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
_LOOSE = re.compile(r"[ \t]+(?=\n|$)|(?<=[ \t])[ \t]+")


def tidy(text: str) -> str:
    """Without spaces at line ends, runs of spaces as one."""
    return _LOOSE.sub("", text)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_bpe`` and
    ``n_bpe_tidy`` (of the tidied text). Null counts as empty; texts count
    whole; repeated rows one by one; columns of these names are replaced; an
    empty table gives an empty one."""
    base = docs.drop("n_words", "n_bpe", "n_bpe_tidy")
    keep = [c for c in base.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in kernel.slices(batches, text):
            raw = kernel.raw(batch.column(text))
            words = [len(x.split()) for x in raw]
            texts = [x.decode() for x in raw]
            bpe = [len(encode(x)) for x in texts]
            again = [n if (y := tidy(x)) == x else len(encode(y)) for x, n in zip(texts, bpe, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in (words, bpe, again))], names=[*keep, "n_words", "n_bpe", "n_bpe_tidy"])

    return base.mapInArrow(run, kernel.extended(base.select(*keep).schema, n_words="long", n_bpe="long", n_bpe_tidy="long"))


class Rollup:
    """Totals kept as committed batches of sums under one shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/batch={batch}"

    def committed(self, batch: str) -> bool:
        fs, p = self._fs(self._folder(batch))
        return fs.exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` (source, lang, version, n_docs, n_tokens; deletes
        with negative numbers) unless the batch is there; whether it was
        added. Sums are formed before the shuffle, so a key with most rows is
        a few rows by then. Sums are written aside and renamed at the end, as
        one step that fails if the batch is there: of two writers of one id
        one wins, and a run that dies midway leaves no batch. Null keys form
        groups of their own, null numbers count as 0, repeated rows count
        each; an empty batch is committed and adds nothing."""
        folder = self._folder(batch)
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_tokens")))
        return self._publish(sums.where("n_docs <> 0 or n_tokens <> 0"), folder)

    def _publish(self, rows: DataFrame, folder: str) -> bool:
        """Write ``rows`` aside, then rename to ``folder`` unless it exists."""
        aside = f"{self.path}/_aside/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        fs, p = self._fs(folder)
        _, q = self._fs(aside)
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(q, p, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception:
            if not fs.exists(p):
                raise
            fs.delete(q, True)
            return False

    def _folders(self, pattern: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{pattern}")
        return sorted(f.getPath().toString() for f in fs.globStatus(p) or [])

    def compact(self) -> int:
        """Fold all batches so far into one table of sums; how many it holds.
        The batches stay as the marks of what is committed, but totals read
        the newest fold and the batches after it, so their work follows the
        groups and the new batches, not the history. The fold lists its
        batches, so one that arrives meanwhile is not lost."""
        folded, rows, after = self._parts()
        if not after:
            return len(folded)
        names = folded | set(after)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        number = 1 + max((int(x.rsplit("fold=", 1)[1]) for x in self._folders("fold=*")), default=0)
        ids = self.spark.createDataFrame([(x,) for x in sorted(names)], "batch string")
        self._publish(sums.withColumn("batch", F.lit(None).cast("string")).unionByName(ids, allowMissingColumns=True), f"{self.path}/fold={number:09d}")
        return len(names)

    def _parts(self) -> tuple[set[str], DataFrame, list[str]]:
        """The newest fold's batches, all rows of sums, the batches after it."""
        folds = self._folders("fold=*")
        rows, folded = self.spark.createDataFrame([], SCHEMA), set()
        if folds:
            fold = self.spark.read.schema(f"{SCHEMA}, batch string").parquet(folds[-1])
            folded = {r["batch"] for r in fold.where("batch is not null").select("batch").collect()}
            rows = fold.where("batch is null").drop("batch")
        after = [x.rsplit("batch=", 1)[1] for x in self._folders("batch=*")]
        after = [x for x in after if x not in folded]
        if after:
            rows = rows.unionByName(self.spark.read.schema(SCHEMA).parquet(*map(self._folder, after)))
        return folded, rows, after

    def totals(self) -> DataFrame:
        """Sums over the committed batches; groups that came to nothing go;
        without batches an empty table."""
        rows = self._parts()[1]
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def changes(counts: DataFrame, columns: dict[str, str], sign: int = 1) -> DataFrame:
    """Change rows of each document: for every version its count column,
    times ``sign``, and ``sign`` documents."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), (F.lit(sign) * F.col(c)).alias("n_tokens")) for v, c in columns.items())))
    return counts.select("source", "lang", each.alias("_c")).select("source", "lang", "_c.version", F.lit(sign).cast("long").alias("n_docs"), F.col("_c.n_tokens").cast("long").alias("n_tokens"))


def revisions(counts: DataFrame, version: str, old: str, new: str) -> DataFrame:
    """Change rows where a document's count was revised: the difference, and
    no documents."""
    return counts.where(F.col(old) != F.col(new)).select("source", "lang", F.lit(version).alias("version"), F.lit(0).cast("long").alias("n_docs"), (F.col(new) - F.col(old)).alias("n_tokens"))
