import pickle
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodegraph.operators.numbering import positions
from lodegraph.sources import tensors as t
from lodegraph.storage import new_path


def vectors(spark, counts, width=3):
    rows = [(1000 * k + i, name, [float(k), i / 2, -float(i)][:width]) for k, (name, n) in enumerate(counts.items()) for i in range(n)]
    return spark.createDataFrame(rows, "node_id long, node_type string, embedding array<float>").repartition(5)


def stored(spark, df, rows=t.FILE_ROWS):
    ids, folder = t.numbered_ids(df).cache(), new_path(spark, "nodes")
    t.write_nodes(ids.join(df.drop("node_type"), "node_id"), folder, rows)
    return folder, ids


def test_positions_of_a_hot_group(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 5000).alias("x"))
    groups = {}
    for r in positions(df.repartition(9), ["g"], [F.col("x").desc()]).collect():
        groups.setdefault(r.g, []).append((r.position, r.x))
    assert sum(map(len, groups.values())) == 5000
    for held in groups.values():
        held.sort()
        assert [p for p, _ in held] == list(range(len(held))) and [x for _, x in held] == sorted((x for _, x in held), reverse=True)


@pytest.mark.parametrize("rows", [t.FILE_ROWS, 7])
def test_there_and_back(spark, monkeypatch, rows):
    df = vectors(spark, {"gene/protein": 40, "drug": 5, "a_b": 1})
    folder, ids = stored(spark, df, rows)
    want = sorted(map(str, df.select("node_id", "node_type", "embedding").collect()))
    assert sorted(map(str, t.node_vectors(spark, folder, ids).collect())) == want
    assert sorted(map(str, t.node_vectors(spark, folder, ids, strict=True).collect())) == want


def test_a_type_reads_its_files_only(spark):
    folder, _ = stored(spark, vectors(spark, {"gene/protein": 40, "drug": 5}), 7)
    (system, path) = t._file(folder)
    with system.open_output_stream(f"{path}/broken_embeddings.pt") as out:
        out.write(b"no archive")
    assert t.read_nodes(spark, folder, ["gene/protein"]).count() == 40
    assert t.read_nodes(spark, folder, ["drug", "none"]).agg(F.max("position")).first()[0] == 4
    assert t.read_nodes(spark, folder, []).count() == 0
    with pytest.raises(Exception, match="zip"):
        t.read_nodes(spark, folder).count()


def test_partitions_have_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(t, "TASK_BYTES", 60)
    folder, _ = stored(spark, vectors(spark, {"a": 23}))
    parts = t.TensorReader(folder, "nodes").partitions()
    assert [(p.first, p.rows) for p in parts] == [(0, 5), (5, 5), (10, 5), (15, 5), (20, 3)]
    got = [v for p in parts for b in t.TensorReader(folder, "nodes").read(p) for v in b.column(2).to_pylist()]
    assert got == [[0.0, i / 2, -float(i)] for i in range(23)]


def test_missing_files_and_counts(spark):
    df = vectors(spark, {"a": 4, "b": 3})
    folder, ids = stored(spark, df)
    assert t.read_nodes(spark, f"{folder}-none").count() == 0
    assert t.read_dictionary(spark, f"{folder}-none/x.pt").count() == 0
    more = ids.union(spark.createDataFrame([(9, "b", 3)], ids.schema))
    fewer = ids.where("position <> 3 or node_type <> 'a'")
    other = ids.union(spark.createDataFrame([(9, "c", 0)], ids.schema))
    assert t.node_vectors(spark, folder, more).count() == 7
    for bad in (more, fewer, other):
        with pytest.raises(Exception, match="differ in number"):
            t.node_vectors(spark, folder, bad, strict=True).collect()


def test_dictionaries(spark, tmp_path):
    for keys, kind in (([5, 3, 70_000, 1 << 40], "long"), (["a b", "é", ""], "string")):
        df = spark.createDataFrame([(k, [float(i), 2.0]) for i, k in enumerate(keys)], f"key {kind}, embedding array<float>")
        path = f"file://{tmp_path}/{kind}/query_emb_dict.pt"
        t.write_dictionary(df, path)
        assert {r.key: r.embedding for r in t.read_dictionary(spark, path).collect()} == {str(k): [float(i), 2.0] for i, k in enumerate(keys)}
    with pytest.raises(ValueError):
        t.write_dictionary(df, path, most_bytes=8)
    t.write_dictionary(df.limit(0), path)
    assert t.read_dictionary(spark, path).count() == 0


class _Call:
    def __reduce__(self):
        return (print, ("run",))


def test_what_a_description_may_not_do(tmp_path, capsys):
    for bad in (_Call(), {1: _Call()}, {1, 2}):
        with pytest.raises(ValueError):
            t.described(pickle.dumps(bad, 2))
    assert capsys.readouterr().out == "" and t.described(pickle.dumps({"a": (1, [2.5, None, True])}, 4)) == {"a": (1, [2.5, None, True])}


def test_strides_and_compression_are_refused(tmp_path):
    for stored_, stride, good in ((zipfile.ZIP_STORED, (3, 1), True), (zipfile.ZIP_STORED, (1, 2), False), (zipfile.ZIP_DEFLATED, (3, 1), False)):
        path = tmp_path / "a_embeddings.pt"
        body = t._tensor("0", (2, 3)).replace(t._numbers((3, 1)), t._numbers(stride))
        with zipfile.ZipFile(path, "w", stored_) as z:
            z.writestr("x/data.pkl", b"\x80\x02" + body + b".")
            z.writestr("x/data/0", struct.pack("<6f", *range(6)))
        reader = t.TensorReader(f"file://{tmp_path}", "nodes")
        if good:
            assert [b.column(2).to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]]
        else:
            with pytest.raises(ValueError):
                reader.partitions()
