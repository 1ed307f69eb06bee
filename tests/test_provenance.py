"""Labels of replicates by every route, through folders as runs leave them."""

import json

import pytest

from sparkloom.operators import provenance
from sparkloom.sources import readers


def run(root, name, numbers, manifest=None, staged=None, progress=None):
    npz = root / name / "npz"
    npz.mkdir(parents=True)
    for i in numbers:
        (npz / f"rep_{i:04d}.npz").write_bytes(b"x")
    if manifest is not None:
        (root / name / "run_manifest.json").write_text(manifest if isinstance(manifest, str) else json.dumps({"replicates": [{"merged_index": i, "source": s} for i, s in enumerate(manifest)]}))
    if staged is not None:
        (root / name / "provenance.json").write_text(staged if isinstance(staged, str) else json.dumps({"replicates": staged}, indent=2))
    if progress is not None:
        (root / name / "logs").mkdir()
        (root / name / "logs" / "progress.jsonl").write_text("\n".join(json.dumps(x) for x in progress) + "\n\n")


def labels(spark, root, name, **how):
    files, *records = readers.run_records(spark, str(root), base=str(root))
    out = provenance.invocations(files.where(f"run like '%/{name}'"), *records, **how)
    return {r["file"]: (r["label"], r["route"], r["source"].split("/")[-1]) for r in out.collect()}


def test_routes(spark, tmp_path):
    by = lambda *pairs: [{"rep_id": f"rep_{i:04d}", "invocation": v} for i, v in pairs]
    run(tmp_path, "staged", [0, 1], staged=by((0, "5"), (1, 6)))
    run(tmp_path, "logged", [0, 1, 2], progress=[{"replicate": 0, "batch": 9}, {"replicate": 0, "batch": 2}, {"replicate": 1, "batch": 2}, {"other": 1}, {"replicate": 2, "batch": 3}])
    # what covers only some files is passed over
    run(tmp_path, "half", [0, 1], staged=by((0, "x")), progress=[{"replicate": 0, "batch": 1}, {"replicate": 1, "batch": 1}])
    run(tmp_path, "lacks", [0], staged=[{"rep_id": "rep_0000", "invocation": "1"}, {"rep_id": "rep_0001"}], progress=[{"replicate": 0, "batch": 4}])
    run(tmp_path, "broken", [0], manifest="{no json", staged="[1]", progress=[{"replicate": 0, "batch": 7}])
    run(tmp_path, "raw", [0, 1, 2, 3, 4])
    assert labels(spark, tmp_path, "staged") == {"rep_0000.npz": ("5", "staged", "staged"), "rep_0001.npz": ("6", "staged", "staged")}
    assert labels(spark, tmp_path, "staged", own_name=True)["rep_0001.npz"][0] == "staged:6"
    assert [labels(spark, tmp_path, "logged")[f"rep_000{i}.npz"][0] for i in range(3)] == ["2", "2", "3"]
    assert {v[:2] for v in labels(spark, tmp_path, "half").values()} == {("1", "progress")}
    assert labels(spark, tmp_path, "lacks") == {"rep_0000.npz": ("4", "progress", "lacks")}
    assert labels(spark, tmp_path, "broken") == {"rep_0000.npz": ("7", "progress", "broken")}
    with pytest.raises(ValueError, match="raw"):
        labels(spark, tmp_path, "raw")
    assert [labels(spark, tmp_path, "raw", per_invocation=2)[f"rep_000{i}.npz"][:2] for i in range(5)] == [(x, "number") for x in "00112"]

    # merged runs, one of them merged again, a relative source, a source that knows nothing
    at = lambda name, i: str(tmp_path / name / "npz" / f"rep_{i:04d}.npz")
    run(tmp_path, "inner", range(3), manifest=[at("logged", 2), at("raw", 4), at("half", 0)])
    run(tmp_path, "outer", range(5), manifest=[at("inner", 0), at("inner", 1), "staged/npz/rep_0001.npz", at("raw", 3), at("inner", 2)])
    got = labels(spark, tmp_path, "outer")
    # of ``half`` only the file that its staged record covers is asked for
    assert [got[f"rep_000{i}.npz"] for i in range(5)] == [("inner:logged:3", "progress", "logged"), ("inner:raw", "name", "raw"), ("staged:6", "staged", "staged"), ("raw", "name", "raw"), ("inner:half:x", "staged", "half")]
    got = labels(spark, tmp_path, "outer", per_invocation=2, own_name=True)
    assert [got[f"rep_000{i}.npz"][0] for i in range(5)] == ["outer:inner:logged:3", "outer:inner:raw:2", "outer:staged:6", "outer:raw:1", "outer:inner:half:x"]
    # a manifest that misses a file doesn't count
    run(tmp_path, "short", [0, 1], manifest=[at("staged", 0)], progress=[{"replicate": i, "batch": 1} for i in (0, 1)])
    assert {v[1] for v in labels(spark, tmp_path, "short").values()} == {"progress"}
    run(tmp_path, "self", [0], manifest=[at("self", 0)])
    with pytest.raises(ValueError, match="itself"):
        labels(spark, tmp_path, "self")
    assert labels(spark, tmp_path, "nowhere") == {}


def test_given(spark):
    files = spark.createDataFrame([("/a/rep_0.npz",), ("/a/rep_1.npz",)], "file string")
    book = lambda *rows: spark.createDataFrame(rows, "rep_file string, invocation int")
    assert {tuple(r) for r in provenance.given(files, book(("rep_1.npz", 7), ("b/rep_0.npz", 8), ("rep_9.npz", 1), ("rep_1.npz", 7))).collect()} == {("/a/rep_0.npz", "8"), ("/a/rep_1.npz", "7")}
    for rows in ([("rep_1.npz", 7)], [("rep_0.npz", 1), ("rep_1.npz", 7), ("rep_1.npz", 8)]):
        with pytest.raises(ValueError, match="1 files .* rep_"):
            provenance.given(files, book(*rows))
