"""Writers of result tables and text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def table_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """CSV with a header, in as many parts as the table has; ``digits`` rounds
    columns here and nowhere before."""
    for c, d in (digits or {}).items():
        df = df.withColumn(c, F.round(c, d))
    df.write.mode("overwrite").option("header", True).csv(path)


def replicates(df: DataFrame, path: str, keys: list[str], observed: DataFrame | None = None) -> None:
    """Parquet by replicate. With ``observed``, every replicate must have
    exactly its keys; a column ``test_id`` numbers them by key order, never by
    row order."""
    if observed is not None:
        from ..operators.nulls import check_replicates

        check_replicates(observed, df, keys)
    df.withColumn("test_id", F.xxhash64(*keys)).repartition("replicate").write.mode("overwrite").partitionBy("replicate").parquet(path)


def reports(df: DataFrame, path: str) -> None:
    """A JSON object per row; NaN and infinity become null."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, title: str) -> DataFrame:
    """(line): a table as Markdown lines, in the order of its first column."""
    cells = lambda cols: F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(df.columns) + " |"), (3, "|" + " - |" * len(df.columns))], "_o int, line string")
    body = df.select(F.col(df.columns[0]).alias("_k"), cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))
    return head.select("_o", F.lit(None).cast(body.schema["_k"].dataType).alias("_k"), "line").unionByName(body.select(F.lit(4).alias("_o"), "_k", "line")).orderBy("_o", "_k").select("line")


def fasta(df: DataFrame, path: str, ident: str = "id", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(ident), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def mapping(df: DataFrame, path: str, gene: str, species: str) -> None:
    """'gene species' lines; rows without a species are an error."""
    df.select(F.when(F.col(species).isNull(), F.raise_error(F.concat(F.lit("no species for "), F.col(gene)))).otherwise(F.concat_ws("\t", gene, species)).alias("value")).write.mode("overwrite").text(path)


def newick(nodes: DataFrame, key: str = "tree") -> DataFrame:
    """(key, text): trees of (key, node, parent, name, length, ord) as text,
    each tree built in one group."""
    import pandas as pd

    def one(f: pd.DataFrame) -> pd.DataFrame:
        kids: dict = {}
        for r in f.sort_values("ord").itertuples():
            kids.setdefault(None if pd.isna(r.parent) else int(r.parent), []).append(r)
        out, todo = {}, [(kids[None][0], False)]
        while todo:
            r, seen = todo.pop()
            below = kids.get(int(r.node), [])
            if below and not seen:
                todo += [(r, True), *((b, False) for b in below)]
                continue
            text = ("(" + ",".join(out[b.node] for b in below) + ")" if below else "") + (r.name_ or "")
            out[r.node] = text + ("" if pd.isna(r.length) else f":{r.length:g}")
        return pd.DataFrame([(f[key].iloc[0], out[kids[None][0].node] + ";")], columns=[key, "text"])

    return nodes.withColumnRenamed("name", "name_").groupBy(key).applyInPandas(one, f"{key} {nodes.schema[key].dataType.simpleString()}, text string")
