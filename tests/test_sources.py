import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkledger.sources import archives, raw, readers, sinks

REPORT = {"filename": "f", "pre_text": ["Sales were 1,234 ."], "post_text": ["End"], "table": [["", "2009", "2008"], ["revenue", "$ 5829", "5735"]]}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    (at / "processed/finqa").mkdir(parents=True)
    rows = [{"uid": "a", "question": "q", "context": "c", "answer": 94.0, "meta": {"dataset": "finqa"}, "later": 1}, {"uid": "b", "question": "q", "context": "c", "answer": "yes"}]
    (at / "processed/finqa/test.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    for run, lines in (("r1", ['{"uid": "a", "correct": true}', '{"uid": "a", "correct": false}', "{broken"]), ("r2", ['{"uid": "b", "correct": true}'])):
        (at / "runs" / run).mkdir(parents=True)
        (at / "runs" / run / "predictions.jsonl").write_text("\n".join(lines))
        (at / "runs" / run / "status.json").write_text('{"exp_id": "%s", "status": "failed"}' % run if run == "r1" else "{")
    return f"file://{at}"


def test_examples(spark, root):
    rows = readers.load_dataset(spark, root, "finqa", "standard").orderBy("uid").collect()
    assert [(r.uid, r.answer.num, r.answer.text) for r in rows] == [("a", 94.0, None), ("b", None, "yes")]
    with pytest.raises(FileNotFoundError):
        readers.load_dataset(spark, root, "finqa", "train")
    assert readers.split_available(spark, root, "nope", "standard")[0] is False
    assert readers.examples_by_uid(spark, root, "tatqa", "dev").count() == 0
    assert readers.fingerprint(spark, root, "finqa", "test").first().file == "processed/finqa/test.jsonl"
    assert readers.split_path("r", "x", "clean") == "r/clean_set/clean.jsonl"
    with pytest.raises(ValueError):
        readers.split_path("r", "finqa", "nope")


def test_runs(spark, root):
    got = {(r.exp_id, r.uid): r.correct for r in readers.item_correctness(readers.load_predictions(spark, f"{root}/runs")).collect()}
    assert got == {("r1", "a"): False, ("r2", "b"): True}
    assert [r.exp_id for r in readers.load_states(spark, f"{root}/runs").collect()] == ["r1"]
    assert readers.load_results(spark, f"{root}/nothing").count() == 0


def test_config_row():
    got = readers.config_row({"epochs": 1, "rate": 0.1, "flag": True, "teacher": None}, {"epochs": "3", "rate": "2e-4", "flag": False, "teacher": "7", "odd": 1})
    assert got == {"epochs": 3, "rate": 2e-4, "flag": False, "teacher": "7"}


def test_finqa(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([
        {"id": "x-1", **REPORT, "qa": {"question": "q", "program": "subtract(5829, 5735), divide(#0, 5735)", "exe_ans": 0.01639, "answer": "1.6%", "gold_inds": {"table_1": "t", "text_0": "s"}}},
        {"id": "x-2", **REPORT, "qa": {"question": "q", "program": "divide(1, 0)", "exe_ans": "yes", "gold_inds": {}}},
    ]))
    a, b = raw.finqa(raw.read_array(spark, f"file://{tmp_path}/t.json", raw.FINQA)).orderBy("uid").collect()
    assert a.program_verified and a.gold_program.endswith("answer = step_1") and a.extra.gold_inds == ["table_1", "text_0"]
    assert a.context == "Sales were 1234 .\n\n|  | 2009 | 2008 |\n|---|---|---|\n| revenue | $ 5829 | 5735 |\n\nEnd"
    assert [(c.row, c.col) for c in a.table_cells] == [(1, 1), (1, 2)]
    assert not b.program_verified and b.gold_program is None and b.answer.text == "yes"


def test_convfinqa(spark, tmp_path):
    turn = {"id": "Single_x_1", **REPORT, "annotation": {"cur_dial": ["q0", "q1"], "exe_ans_list": [5829.0, 94.0], "cur_program": "subtract(5829, 5735)", "exe_ans": 94.0, "cur_type": "program", "qa_split": False}}
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("data/dev_turn.json", json.dumps([turn]))
    r = raw.convfinqa(archives.read_records(spark, f"file://{tmp_path}/data.zip", raw.CONVFINQA, "data/dev_turn.json")).first()
    assert r.question == "q1" and r.extra.turn_index == 1 and r.extra.conversation_id == "Single_x" and r.program_verified
    assert [(h.question, h.answer.num) for h in r.extra.history] == [("q0", 5829.0)]


def test_tatqa(spark, tmp_path):
    q = lambda i, a, kind, d="", scale="": {"uid": f"q{i}", "order": i, "question": "?", "answer": a, "derivation": d, "answer_type": kind, "answer_from": "table", "scale": scale}
    doc = {"table": {"uid": "t", "table": [["", "2019"], ["a", "1,617"], ["b", "1,434"]]}, "paragraphs": [{"uid": "p", "order": 2, "text": "two"}, {"uid": "o", "order": 1, "text": "one 1,000"}],
           "questions": [q(2, 12.76, "arithmetic", "(1,617-1,434)/1,434", "percent"), q(1, ["x", "y"], "multi-span"), q(3, "7", "count")]}
    (tmp_path / "d.json").write_text(json.dumps([doc]))
    got = raw.tatqa(raw.read_array(spark, f"file://{tmp_path}/d.json", raw.TATQA)).orderBy("uid").collect()
    assert got[0].answer.text == "x; y" and got[2].answer.num == 7.0
    assert got[1].gold_program == "answer = ((1617-1434)/1434) * 100" and [c.text for c in got[1].table_cells] == ["1,617", "1,434"]
    assert got[0].context.endswith("\n\none 1000\ntwo")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("finqa", "A5", 0.51234, 0.4, 0.6, "a|b")], "dataset string, arm string, em double, em_lo double, em_hi double, note string")
    assert sinks.markdown_table(df) == "| dataset | arm | em | note |\n|---|---|---|---|\n| finqa | A5 | 0.512 [0.400, 0.600] | a/b |"
    assert "a|b" in sinks.html_table(df)
    page, text = sinks.report("T<", {"One": df, "None": df.limit(0)})
    assert "T&lt;" in page and "## One" in text and "None" not in text
    sinks.write_csv(df, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["dataset", "arm", "em", "em_hi", "em_lo", "note"]
    files = spark.createDataFrame([("a/result.json",), ("a/w.safetensors",), ("a/checkpoint-5/x.json",), ("a/last.ckpt",), ("a/checkpoints/s/x.json",), (".zip",), ("a/my.checkpoints/x",)], "path string")
    assert [r.path for r in sinks.packable(files).collect()] == ["a/result.json", ".zip", "a/my.checkpoints/x"]
    items = spark.createDataFrame([("finqa", "dev", "p"), ("finqa", "dev", None)], "dataset string, split string, gold_program string")
    assert "| finqa | dev | 2 | 1 |" in sinks.dataset_card(items, "Data", "1", "abc")
    assert json.loads(sinks.manifest(items, "1", "abc"))["datasets"] == {"finqa": {"dev": {"n": 2, "n_verified": 1}}}


def test_nested_values(spark):
    df = spark.sql("""select parse_json('{"gpu": {"n_gpus": 2}, "s": "x"}') as v""")
    r = df.select(readers.nested(F.col("v"), "gpu.n_gpus", "int").alias("a"), readers.nested(F.col("v"), "gpu.train_seconds", "double", 0.0).alias("b"), readers.nested(F.col("v"), "s", "int", 7).alias("c")).first()
    assert tuple(r) == (2, 0.0, 7)


def test_archives(spark, tmp_path):
    at = f"file://{tmp_path}/z"
    files = spark.createDataFrame([(f"r{i:03d}/{n}", f"{i}{n}é".encode()) for i in range(50) for n in ("a.json", "w.bin", "checkpoints/c.json")] + [("empty", None)], "path string, content binary")
    for again in ("one", "two"):
        archives.pack_outputs(files.repartition(5 if again == "one" else 2), f"{at}/{again}", 3)
    names = sorted(p.name for p in (tmp_path / "z/one").iterdir() if not p.name.startswith("."))
    assert names == sorted(p.name for p in (tmp_path / "z/two").iterdir() if not p.name.startswith(".")) and 1 < len(names) <= 3
    assert all((tmp_path / "z/one" / n).read_bytes() == (tmp_path / "z/two" / n).read_bytes() for n in names)
    found = archives.read_members(spark, f"{at}/one", partitionbytes=20)
    got = {r.member: bytes(r.content) for r in found.collect()}
    assert got == {**{f"r{i:03d}/a.json": f"{i}a.jsoné".encode() for i in range(50)}, "empty": b""} and found.rdd.getNumPartitions() > 10
    broken = files.withColumn("content", F.when(F.col("path") == "r030/a.json", F.raise_error(F.lit("on purpose"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="on purpose"):
        archives.write_members(broken, f"{at}/three")
    assert not list((tmp_path / "z").glob("three/*.zip"))
    (tmp_path / "z/none").mkdir()
    assert archives.read_members(spark, f"{at}/none").count() == 0


def test_archives_hold_bounded_members(spark, tmp_path):
    at, n = f"file://{tmp_path}/z", 150_000
    archives.pack_outputs(spark.range(n).select(F.col("id").cast("string").alias("path"), F.col("id").cast("string").cast("binary").alias("content")), at, 1)
    archives.write_members(spark.range(0, n, 1, 1).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("path"), F.lit(b"").alias("content")), at)
    held = [len(zipfile.ZipFile(p).namelist()) for p in (tmp_path / "z").glob("*.zip")]
    assert max(held) <= archives.MEMBERS and sum(held) == 2 * n and len(held) >= 8
    found = archives.read_members(spark, at)
    assert found.select("member").distinct().count() == 2 * n and found.where("content = cast(member as binary)").count() == n
    assert all(p.last is None for p in archives._Reader({"path": at}).partitions())  # planned without their directories


def test_arrays_are_read_in_blocks():
    import io

    values = [1, "a,]b", {"x": [1, 2, {"y": "é"}]}, None, -2.5e3, [], "z" * 100, 12345678901]
    for size in (1, 3, 7, 1000):
        for text in (json.dumps(values), json.dumps(values, indent=2, ensure_ascii=False) + "\n"):
            assert [json.loads(x) for x in archives.array_elements(io.BytesIO(text.encode()), size)] == values
    assert list(archives.array_elements(io.BytesIO(b" [ ] "))) == []
    for bad in (b"{}", b"[1, 2", b"[1] 2", b"[1, x]", b""):
        with pytest.raises(ValueError):
            list(archives.array_elements(io.BytesIO(bad), 2))


def test_settings(spark, tmp_path):
    (tmp_path / "pricing.yaml").write_text('# prices: none\ngpus:\n  T4:\n    usd_per_gpu_hour: null\n    source: ""   # later\n  A100:\n    usd_per_gpu_hour: 1.5\n    source: "a: b"\n')
    (tmp_path / "speeds.yaml").write_text("train_tokens_per_s:   # x\n  q-3b: 310   # measured\nanswers_per_s:\n  q-3b:   {answer: 1.0,  pot: 0.4}    # y\n  l.1: {answer: 0.38}\nload_hours: 0.03\n")
    (tmp_path / "models.yaml").write_text('models:\n  q-3b:\n    size_b: 3.0\n    tier: student\n\n  l.1:\n    cutoff: "2024-09-19"    # release\n    tier: large\n')
    at = f"file://{tmp_path}"
    assert [(r.gpu_key, r.usd_per_gpu_hour) for r in readers.load_prices(spark, f"{at}/pricing.yaml").orderBy("ord").collect()] == [("T4", None), ("A100", 1.5)]
    assert readers.load_prices(spark, f"{at}/none.yaml").count() == 0
    assert {r.model: r.speeds for r in readers.load_speeds(spark, f"{at}/speeds.yaml").collect()} == {"q-3b": {"answer": 1.0, "pot": 0.4}, "l.1": {"answer": 0.38}}
    assert {r.model: r.speeds for r in readers.load_speeds(spark, f"{at}/speeds.yaml", "train_tokens_per_s").collect()} == {"q-3b": {"": 310.0}}
    models = readers.load_models(spark, f"{at}/models.yaml")
    assert {r.model: r.fields for r in models.collect()} == {"q-3b": {"size_b": "3.0", "tier": "student"}, "l.1": {"cutoff": "2024-09-19", "tier": "large"}}
    rows = spark.createDataFrame([("q-3b",), ("other",)], "model string")
    assert readers.with_model(rows.limit(1), models).first().fields["tier"] == "student"
    with pytest.raises(Exception, match="unknown model 'other'; known: l.1, q-3b"):
        readers.with_model(rows, models).collect()


def test_models_of_a_long_table_are_joined(spark):
    models = spark.range(1500).select(F.format_string("m%04d", "id").alias("model"), F.create_map(F.lit("tier"), F.col("id").cast("string")).alias("fields"))
    rows = spark.range(3000).select((F.col("id") * 7).alias("k"), F.format_string("m%04d", F.col("id") % 1500).alias("model"))
    found = readers.with_model(rows, models)
    assert found.count() == 3000 and found.where(F.col("fields")["tier"] == F.col("model").substr(2, 4).cast("int").cast("string")).count() == 3000
    assert "map_from_entries" not in found._jdf.queryExecution().toString()  # a map of all models is searched from its start for every row
    with pytest.raises(Exception, match=r"unknown model 'x'; known: m0000, .*m0999, \.\.\."):
        readers.with_model(spark.createDataFrame([("x",)], "model string"), models).collect()
    with pytest.raises(Exception, match="is there twice"):
        readers.with_model(rows, models.union(models)).collect()


def test_config_fields_as_config_row(spark):
    defaults = {"epochs": 1, "rate": 0.1, "flag": True, "teacher": None}
    given = {"epochs": "3", "rate": "2e-4", "teacher": "7", "odd": "1"}
    df = spark.createDataFrame([(given,), ({},)], "g map<string,string>")
    a, b = (r.asDict() for r in df.select(*readers.config_fields(F.col("g"), defaults)).collect())
    assert a == readers.config_row(defaults, given) and b == defaults


def test_rendered_by_group(spark):
    df = spark.createDataFrame([("a", 2, "x|<y>"), ("a", 1, None), ("b", 3, "z")], "g string, n int, t string")
    got = {r.g: r.text for r in sinks.markdown_tables(df, ["g"], ["n"], 1).collect()}
    assert got == {"a": "| n | t |\n|---|---|\n| 1 |  |", "b": "| n | t |\n|---|---|\n| 3 | z |"}
    assert sinks.html_tables(df.where("n = 2"), ["g"], ["n"]).first().text == "<table><tr><th>n</th><th>t</th></tr><tr><td>2</td><td>x|&lt;y&gt;</td></tr></table>"
    assert sinks.markdown_table(df.limit(0)) == "| g | n | t |\n|---|---|---|"
