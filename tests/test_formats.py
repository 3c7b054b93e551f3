"""Dataset formats, written and read again."""

from tessera.sources import formats

ONE = [("x:a", "p", "x:b"), ("x:b", "q", "x:c"), ("x:B", "p", "x:a")]
TWO = [("y:1", "k", "y:2"), ("y:2", "k", "y:3")]
LINKS = [("x:a", "y:1"), ("x:b", "y:2"), ("x:z", "y:9")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def data(spark, all_links=False):
    one, two = (spark.createDataFrame(t, formats.URI_TRIPLE) for t in (ONE, TWO))
    return formats.encoded(one, two, spark.createDataFrame(LINKS, formats.URI_PAIR), all_links)


def test_ids_follow_code_points(spark):
    d = data(spark)
    assert rows(d.one.entities) == [(0, "x:B"), (1, "x:a"), (2, "x:b"), (3, "x:c")]
    assert rows(d.alignment.select("e1", "e2")) == [(1, 0), (2, 1)]
    assert rows(data(spark, True).alignment.select("e1", "e2")) == [(1, 0), (2, 1), (4, 3)]


def test_uniform_round_trip(spark, tmp_path):
    d = data(spark)
    formats.write_uniform(d, str(tmp_path), ("k1", "k2"))
    e = formats.read_uniform(spark, str(tmp_path), ("k1", "k2"))
    for a, b in ((d.one, e.one), (d.two, e.two)):
        assert rows(a.entities) == rows(b.entities) and rows(a.triples) == rows(b.triples) and rows(a.relations) == rows(b.relations)
    assert rows(d.alignment) == rows(e.alignment)


def test_openea_and_unified(spark, tmp_path):
    d = data(spark)
    formats.write_openea(d, str(tmp_path / "o"))
    e = formats.read_any(spark, str(tmp_path / "o"))
    assert rows(e.one.triples) == rows(d.one.triples) and rows(e.alignment) == rows(d.alignment)
    formats.write_unified(d, str(tmp_path / "u"))
    u = formats.read_any(spark, str(tmp_path / "u"))
    assert u.two.triples.count() == 2 and u.alignment.count() == 2
    lines = spark.read.text(str(tmp_path / "u" / "triples_2")).collect()
    assert sorted(r.value for r in lines) == ["4\t2\t5", "5\t2\t6"]


def test_empty_file(spark, tmp_path):
    (tmp_path / "none").write_text("")
    assert formats.read_tsv(spark, str(tmp_path / "none"), formats.PAIR).count() == 0


def test_attributes_and_log(spark, tmp_path):
    (tmp_path / "attrs").write_text("e1\ta\tb\ne2\n")
    assert rows(formats.read_attributes(spark, str(tmp_path / "attrs"))) == [("e1", "a"), ("e1", "b")]
    for k in range(2):
        formats.log_events(spark, str(tmp_path / "log"), [{"machine": "server", "process": "p", "iteration": k, "value": 1}])
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_named_kinds(spark, tmp_path):
    for name, lines in (("rel_triples_1", ONE), ("rel_triples_2", TWO), ("ent_links", LINKS)):
        (tmp_path / name).write_text("".join("\t".join(r) + "\n" for r in lines))
    assert formats.read_any(spark, str(tmp_path)).alignment.count() == 2
    assert formats.read_any(spark, str(tmp_path), "2m").alignment.count() == 3
    for old, new in (("rel_triples_1", "triples_1"), ("rel_triples_2", "triples_2")):
        (tmp_path / old).rename(tmp_path / new)
    assert rows(formats.read_any(spark, str(tmp_path)).alignment.select("e1", "e2")) == [(1, 0), (2, 1)]


def test_dbp15k(spark, tmp_path):
    files = {"s_triples": ONE, "t_triples": TWO, "ent_ILLs": LINKS[:2], "rel_ILLs": [("p", "k")], "name_pseudo_mappings.txt": [("x:c", "y:3")]}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join("\t".join(r) + "\n" for r in lines))
    d = formats.read_any(spark, str(tmp_path))
    assert rows(d.alignment.select("e1", "e2")) == [(1, 0), (2, 1)] and rows(d.relation_alignment) == [(0, 0)] and rows(d.names.select("e1", "e2")) == [(3, 2)]


def test_joint(spark, tmp_path):
    d = data(spark)
    split = d.alignment.withColumn("split", formats.F.when(formats.F.col("e1") == 1, "train").otherwise("test"))
    formats.write_unified(formats.Dataset(d.one, d.two, split), str(tmp_path))
    j = formats.read_joint(spark, str(tmp_path))
    assert rows(j.entities) == [(k,) for k in range(7)] and rows(j.relations) == [(k,) for k in range(4)]
    assert sorted(r.r for r in j.triples.collect()) == [1, 1, 2, 3, 3] and rows(j.pairs) == [(1, 4, "train"), (2, 5, "test")]
    k = formats.read_joint(spark, str(tmp_path), reserve=False, listed=False, train=0.5)
    assert rows(k.relations) == [(0,), (1,), (2,)] and k.entities.count() == 7 and sorted(r.split for r in k.pairs.collect()) == ["test", "train"]
    assert rows(formats.read_longs(spark, str(tmp_path / "triples_2"), 2)) == [(4, 2), (5, 2)]
    assert rows(formats.read_ids(spark, [str(tmp_path / f"ent_ids_{k}") for k in (1, 2)]))[0] == ("x:B", 0)


def test_partition_links(spark, tmp_path):
    d = data(spark)
    split = d.alignment.select("e1", "e2").withColumn("split", formats.F.when(formats.F.col("e1") == 1, "train").otherwise("test"))
    more = split.unionByName(spark.createDataFrame([(3, 99, "test")], "e1 long, e2 long, split string"))
    formats.write_partition(formats.Dataset(d.one, d.two, more), str(tmp_path))
    read = lambda n: sorted(r.value for r in spark.read.text(str(tmp_path / n)).collect())
    assert read("train_links") == ["x:a\ty:1"] and read("test_links") == ["x:b\ty:2"] and read("valid_links") == []
    assert read("test_alignment_valid.txt") == ["2\t1"] and read("test_alignment_invalid.txt") == ["3\t99"]


def test_vectors_and_documents(spark, tmp_path):
    v = spark.createDataFrame([(1, 5, [0.5, 1.0]), (2, 6, [])], "side int, id long, vec array<float>")
    formats.write_vectors(v, str(tmp_path / "v"))
    assert rows(formats.read_vectors(spark, str(tmp_path / "v"))) == rows(v)
    docs = spark.createDataFrame([(1, "a")], "id long, s string")
    formats.write_documents(docs, str(tmp_path / "d"))
    assert rows(formats.read_documents(spark, str(tmp_path / "d"), "id long, s string")) == [(1, "a")]
    (tmp_path / "p" / "partition_3").mkdir(parents=True)
    (tmp_path / "p" / "partition_3" / "pred_alignment.json").write_text('{"pred_alignment_csls": [[1, 2], [3, 4]]}')
    assert rows(formats.read_predictions(spark, str(tmp_path / "p"))) == [(3, 1, 2), (3, 3, 4)]
    formats.log_events(spark, str(tmp_path / "log"), [{"process": "p", "value": 2}])
    assert formats.read_log(spark, str(tmp_path / "log")).first().value == 2
