"""Ladders, documents, translation, sources, streams."""

import glob
import os
import subprocess
import sys
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from clearlines import HEURISTIC, IDENTITY, THREE, TWO, UNGATED, Generator, Rule, fixed, simplify, simplify_and_translate, simplify_by_rule
from clearlines.operators.generate import generate
from clearlines.operators.ladder import run_ladder
from clearlines.operators.translate import translate
from clearlines.plans.staging import Staging, shared_folder
from clearlines.queries.jobs import shortening_model
from clearlines.sources import pairs as sources
from clearlines.sources.tables import spread
from clearlines.queries import jobs as queries_jobs
from clearlines.streaming.documents import simplify_stream

LONG = "The committee, which had deliberated extensively, reached a unanimous decision regarding infrastructure spending."


def tries_model(answers):
    """A model that gives its n-th answer to the n-th kind of prompt, by sentence."""
    def build():
        def call(prompts, budgets):
            out = []
            for p in prompts:
                kind = 1 if "easier words" in p or "aggressively" in p else 2 if "very plain" in p else 0
                key = next(k for k in sorted(answers, key=len, reverse=True) if k in p)
                out.append(answers[key][kind])
            return out

        return call

    return build


def ladder_result(spark, ladder, answers):
    df = spark.createDataFrame([(i, 0, s) for i, s in enumerate(answers)], "doc_id long, pos int, sentence string")
    rows = run_ladder(df, ["doc_id", "pos"], Generator(tries_model(answers)), ladder, partitions=2).collect()
    assert len(rows) == len(answers)
    return {r.sentence: r.simplified for r in rows}


CASES = {
    # passes at once, at the second, at the third try
    LONG: ["the committee reached a unanimous decision regarding infrastructure", "x", "y"],
    LONG + " A": [LONG + " A", "the committee reached a unanimous decision on infrastructure", "y"],
    LONG + " B": ["", "committee of 9 reached decision", "The committee had deliberated, reached a unanimous decision on spending"],
    # none passes: a usable try, no usable try, all blank
    LONG + " C": ["They all got to say yes to it", "So yes to it", "All say yes to it now ok"],
    "rapid growth of tools in this manner is here, said he": ["", "", ""],
    "No key up or in it": [" ", "A new and totally different sentence with extraordinarily complicated vocabulary", ""],
    "Word　space  and more of this": ["Word space and more of this", "word", "w"],
}


REGARDING = "The committee reached a unanimous decision regarding infrastructure."
ON = "The committee reached a unanimous decision on infrastructure."

#: What the cases become, in their order. Blank answers are answers: they are the shortest.
AFTER = {
    "two": [REGARDING, ON, "", "So yes to it.", "", "", "Word."],
    "three": [REGARDING, ON, "The committee had deliberated, reached a unanimous decision on spending.", "So yes to it.",
              "Fast growth of tools in this way is here.",
              "A new and totally different sentence with extraordinarily complicated vocabulary.", "Word space and more of this."],
    "ungated": [REGARDING, LONG, f"{LONG} B.", "They all got to say yes to it.", "Rapid growth of tools in this manner is here, said he.",
                "No key up or in it.", "Word space and more of this."],
}


@pytest.mark.parametrize("name, ladder", [("two", TWO), ("three", THREE), ("ungated", UNGATED)])
def test_ladders(spark, name, ladder):
    got = ladder_result(spark, ladder, CASES)
    assert [got[s] for s in CASES] == AFTER[name]


@pytest.mark.parametrize("ladder", [TWO, THREE, UNGATED])
def test_rule_and_model_agree(spark, folder, ladder):
    """A rule and a model that says the same take the same way."""
    df = spark.read.parquet(f"{folder}/documents.parquet").limit(40).select("doc_id", "text")

    def first_half():
        return lambda prompts, budgets: [_sentence_of(p)[: len(_sentence_of(p)) // 2] for p in prompts]

    def _sentence_of(p):
        for before, after in (("### Input:\n", "\n\n### Response:"), ("Now simplify:\n\nInput: ", "\nOutput:\n"),
                              ("\nSentence: ", "\nSimple:\n"), ("\nSentence: ", "\nPlain English:\n")):
            if before in p and after in p:
                return p.split(before, 1)[1].rsplit(after, 1)[0]

    rule = Rule((lambda s: F.substr(s, F.lit(1), F.floor(F.length(s) / 2).cast("int")),))
    by_rule = {r.doc_id: r.simplified for r in simplify(df, generator=rule, ladder=ladder).collect()}
    by_model = {r.doc_id: r.simplified for r in simplify(df, generator=Generator(first_half), ladder=ladder, partitions=3).collect()}
    assert by_rule == by_model and len(by_rule) == 40


def test_documents(spark):
    rows = [(1, "One here. Two there. Three."), (2, "  "), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.simplified, r.sentences) for r in simplify(df, generator=IDENTITY, ladder=UNGATED).collect()}
    assert got == {1: ("One here. Two there. Three.", 3), 2: ("  ", 0), 3: (None, 0), 4: ("", 0)}
    got = {r.doc_id: r.simplified for r in simplify_by_rule(df, rule=HEURISTIC).collect()}
    assert got == {1: "One here. Two there. Three.", 2: "  ", 3: None, 4: ""}


def test_failing_calls_are_isolated(spark):
    def build():
        def call(prompts, budgets):
            if any("bad" in p for p in prompts):
                raise RuntimeError("cannot")
            return ["fine answer" for _ in prompts]

        return call

    df = spark.createDataFrame([(1, "All good now. A bad one. Good again.")], "doc_id long, text string")
    row = simplify(df, generator=Generator(build), ladder=UNGATED, partitions=1).first()
    assert row.simplified == "Fine answer. A bad one. Fine answer." and (row.sentences, row.failed_calls) == (3, 1)
    short = spark.createDataFrame([("x", "Hindi"), ("\n ", "Hindi")], "t string, l string")
    rows = {r.t: r for r in translate(short, "t", "l", lambda: lambda texts, tag: []).collect()}
    assert "ValueError" in rows["x"].translate_error and rows["x"].translated == "x" and rows["\n "].translate_error is None


def test_a_failed_call_never_costs_a_sentence(spark):
    """First call fails, second candidate fails the gate; then both calls fail."""
    def build():
        def call(prompts, budgets):
            if any("zeroth" in p and "easier words" not in p or "twain" in p for p in prompts):
                raise RuntimeError("cannot")
            return ["Seven new words that nobody asked for, 99" for _ in prompts]

        return call

    df = spark.createDataFrame([(1, "Fine words here. The zeroth of them fails entirely. Now the twain fail entirely.")], "doc_id long, text string")
    row = simplify(df, generator=Generator(build), ladder=TWO, partitions=1).first()
    assert row.simplified == ("Seven new words that nobody asked for, 99. Seven new words that nobody asked for, 99. "
                              "Now the twain fail entirely.")
    assert (row.sentences, row.failed_calls) == (3, 3)


def test_failed_calls_of_rows_that_pass_later_count(spark):
    def build():
        def call(prompts, budgets):
            if any("easier words" not in p for p in prompts):
                raise RuntimeError("cannot")
            return ["the committee reached a unanimous decision regarding infrastructure"] * len(prompts)

        return call

    df = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    row = simplify(df, generator=Generator(build), ladder=TWO, partitions=1).first()
    assert row.simplified == "The committee reached a unanimous decision regarding infrastructure." and row.failed_calls == 1


def test_two_runs_share_a_staging(spark):
    staging = Staging(spark)
    frames = [spark.createDataFrame([(1, f"{LONG} Run {i}.")], "doc_id long, text string") for i in (1, 2)]
    done = [simplify(f, generator=Generator(shortening_model), ladder=TWO, staging=staging, partitions=1) for f in frames]
    assert [d.first().simplified[-6:] for d in done] == ["Run 1.", "Run 2."]
    staging.write(spark.range(3), "t")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        staging.write(spark.range(3), "t")
    staging.close()
    with pytest.raises(Exception):
        done[0].collect()


@pytest.mark.parametrize("rows", [[(None, "One. Two.")], [(1, "One. Two."), (1, "Three. Four.")], [(1, "One. Two."), (1, "")],
                                  [(1, "One. Two."), (1, "Three.")]])
def test_keys_must_name_one_document(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.raises(Exception, match="key"):
        simplify(df, generator=IDENTITY, ladder=UNGATED).collect()


def test_workers_need_not_have_the_package(tmp_path):
    """A session started from an empty folder, with nothing on the path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
from clearlines.queries import all_queries
for name in ("generate_identity", "ladder_two", "translate_identity", "similarity_ratio"):
    assert all_queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]


def test_model_is_loaded_on_the_worker_and_asked_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def build():
        def call(prompts, budgets):
            with open(log, "a") as out:
                out.writelines("2\n" if "easier words" in p else "1\n" for p in prompts)
            return [p.split("### Input:\n")[1].split("\n")[0].split(",")[0] for p in prompts]

        return call

    df = spark.createDataFrame([(i, f"{LONG} Number {i}." if i % 2 else "Plain words only.") for i in range(20)], "doc_id long, text string")
    done = simplify(df, generator=Generator(build), ladder=TWO, partitions=3)
    done.collect(), done.count(), done.collect()
    # 10 documents of two sentences and 10 of one; no answer passes, for it is the sentence itself or two words of LONG
    asked = open(log).read().split()
    assert (asked.count("1"), asked.count("2")) == (30, 30)


def test_translator_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def build():
        def call(texts, tag):
            with open(log, "a") as out:
                out.write("x\n" * len(texts))
            return texts

        return call

    df = spark.createDataFrame([(i, "Some words." if i % 4 else "\t\n") for i in range(20)], "doc_id long, text string")
    done = simplify_and_translate(df, build, ["Tamil", "Urdu"], generator=IDENTITY, ladder=UNGATED, partitions=3)
    done.collect(), done.count(), done.collect()
    assert len(open(log).read().split()) == 2 * 15


def test_two_stages(spark):
    df = spark.createDataFrame([(1, "One , two. Three")], "doc_id long, text string")
    done = simplify_and_translate(df, lambda: lambda texts, tag: [f"{tag}|{t}" for t in texts], ["Tamil", "Nowhere"],
                                  generator=IDENTITY, ladder=UNGATED)
    assert {r.language: r.translated for r in done.collect()} == {
        "Tamil": "tam_Taml|eng_Latn tam_Taml One, two. Three.", "Nowhere": "hin_Deva|eng_Latn hin_Deva One, two. Three."}


class Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, named, master, known=None):
        self.sparkContext, self.master, self.known, self.named = self, master, known, named
        self.conf = self

    def get(self, key, default=None):
        return {"spark.checkpoint.dir": self.named, "spark.sql.warehouse.dir": "hdfs://warehouse"}.get(key, default)

    def getCheckpointDir(self):
        return self.known


def test_shared_folder(spark):
    assert shared_folder(Session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    assert shared_folder(Session(None, "yarn", "hdfs://set")) == "hdfs://set"
    assert shared_folder(Session(None, "yarn")) == "hdfs://warehouse/checkpoints"
    staging = Staging(spark, "run-of-test")
    assert staging.path("t").endswith("/clearlines/run-of-test/t") and staging.write(spark.range(5), "t").count() == 5


PAIRS = [(1, 'A "quoted", cell', "plain"), (2, "two\nlines", "b"), (3, None, "c"), (4, " spaced ", "d\\e")]


def test_pairs_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAIRS, "pair_id long, Normal string, Simple string")
    path = str(tmp_path / "pairs")
    sources.write_csv(df.coalesce(1), path)
    read = sources.read_pairs(spark, path, key="pair_id")
    assert sorted(map(tuple, read.collect())) == PAIRS
    assert sources.missing_counts(read).first().asDict() == {"normal": 1, "simple": 0}
    both = sources.read_splits(spark, {"train": path, "test": path}, key="pair_id")
    assert both.groupBy("split").count().count() == 2 and both.count() == 8
    predictions = spark.createDataFrame([(1, "m", "p, \"1\""), (2, "m", "p\n2")], "pair_id long, system string, predicted string")
    for fmt in ("parquet", "csv"):
        out = str(tmp_path / fmt)
        sources.write_predictions(read, predictions, out, fmt)
        got = sources.read_predictions(spark, out, fmt).select("pair_id", "normal", "predicted").orderBy("pair_id")
        assert [tuple(r) for r in got.collect()] == [(1, PAIRS[0][1], 'p, "1"'), (2, PAIRS[1][1], "p\n2")]
    sources.write_table(read, str(tmp_path / "t.parquet"))
    first = sources.first_rows(spark.read.parquet(str(tmp_path / "t.parquet")), "pair_id", 2)
    assert sorted(r.pair_id for r in first.collect()) == [1, 2]


def test_a_repeated_run_counts_once(spark, tmp_path):
    path = str(tmp_path / "r")
    for run, value in (("one", 1.0), ("two", 2.0), ("one", 3.0)):
        sources.write_report(spark.createDataFrame([("s", "m", value)], "system string, metric string, value double"), path, run)
    assert sorted((r.run, r.value) for r in spark.read.parquet(path).collect()) == [("one", 3.0), ("two", 2.0)]


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    """5,000 rows in three CSV files and in Parquet, read in parts of 4 KB and whole; cells with line breaks."""
    rows = spark.range(5000).select(F.concat(F.lit("row "), F.col("id").cast("string")).alias("Normal"),
                                    F.when(F.col("id") % 11 > 0, F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("Simple"))
    in_order = rows.coalesce(1).repartitionByRange(3, F.regexp_extract("Normal", "[0-9]+", 0).cast("int"))
    sources.write_csv(in_order, str(tmp_path / "csv"))
    in_order.write.option("parquet.block.size", 4096).parquet(str(tmp_path / "pairs.parquet"))
    usual, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("4k", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            plain = sources.read_csv(spark, str(tmp_path / "csv"), multi_line=False)
            seen.append(plain.rdd.getNumPartitions())
            for read in (sources.read_pairs(spark, str(tmp_path / "csv"), multi_line=False), sources.read_pairs(spark, str(tmp_path / "csv")),
                         sources.read_pairs(spark, str(tmp_path / "pairs.parquet"))):
                found = read.select("pair_id", "normal").collect()
                assert sorted(r.pair_id for r in found) == list(range(5000)) and all(r.normal == f"row {r.pair_id}" for r in found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert seen[0] > 10 > seen[1]


def test_aligned_files_of_unequal_length(spark, tmp_path):
    pairs = spark.createDataFrame([("a\nb", "c"), ("d", None)], "Normal string, Simple string")
    sources.write_csv(pairs.coalesce(1), str(tmp_path / "p"))
    for n in (2, 3):
        told = spark.createDataFrame([(f"t{i}",) for i in range(n)], "Predicted string")
        sources.write_csv(told.coalesce(1), str(tmp_path / str(n)))
    read = sources.read_aligned(spark, str(tmp_path / "p"), str(tmp_path / "2")).orderBy("pair_id").collect()
    assert [tuple(r) for r in read] == [(0, "a\nb", "c", "t0", "system"), (1, "d", None, "t1", "system")]
    with pytest.raises(Exception, match="different numbers of rows"):
        sources.read_aligned(spark, str(tmp_path / "p"), str(tmp_path / "3")).collect()


@pytest.mark.parametrize("bad, calls", [((), 1), ((37,), 13), ((0, 63), 23), (tuple(range(64)), 127)])
def test_failing_batches_are_halved(spark, tmp_path, bad, calls):
    """One bad prompt of 64 costs 1 + 2 log2(64) calls."""
    log = str(tmp_path / "log")

    def load():
        def call(prompts, budgets):
            with open(log, "a") as file:
                file.write("x")
            if any(int(p) in bad for p in prompts):
                raise ValueError("bad prompt")
            return [p + "!" for p in prompts]
        return call

    df = spark.range(0, 64, 1, 1).select(F.col("id").cast("string").alias("p"))
    found = generate(df, Generator(load), F.col("p"), F.lit(9)).collect()
    assert {int(r.p) for r in found if r.raw is None} == set(bad) == {int(r.p) for r in found if r.error == "ValueError: bad prompt"}
    assert len(open(log).read()) == calls


def test_lone_prompts_are_asked_again(spark, tmp_path):
    def load():
        asked = []

        def call(prompts, budgets):
            asked.append(prompts)
            if len(asked) < 3:
                raise TimeoutError("busy")
            return list(prompts)
        return call

    df = spark.createDataFrame([("only",)], "p string")
    assert generate(df, Generator(load, retries=1), F.col("p"), F.lit(9)).first().raw is None
    assert generate(df, Generator(load, retries=2, wait=0.01), F.col("p"), F.lit(9)).first().raw == "only"


def test_spread(spark):
    small = spark.range(10, numPartitions=1)
    assert spread(small, "id") is small
    assert "hashpartitioning(id" in spread(small, "id", 12)._jdf.queryExecution().toString()


@pytest.mark.parametrize("by_model", [False, True])
def test_stream_equals_batch(spark, folder, tmp_path, by_model):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30).select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    generator = Generator(shortening_model) if by_model else HEURISTIC
    out = str(tmp_path / "out")
    before = len(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/clearlines/*/ladder-*/attempt_*"))
    simplify_stream(stream, out, str(tmp_path / "state"), generator, TWO if by_model else None, partitions=2).awaitTermination()
    docs = spark.read.parquet(str(tmp_path / "in"))
    batch = simplify(docs, generator=generator, ladder=TWO) if by_model else simplify_by_rule(docs)
    got = {r.doc_id: r.simplified for r in spark.read.parquet(out).collect()}
    left = glob.glob(f"{shared_folder(spark).removeprefix('file:')}/clearlines/*/ladder-*/attempt_*")
    assert len(left) == before + (2 if by_model else 0)  # the micro-batches' stages are gone, those of `batch` are there
    assert got == {r.doc_id: r.simplified for r in batch.collect()} and len(got) == 30


def test_ladder_is_data(spark):
    once = replace(TWO, attempts=TWO.attempts[:1])
    assert ladder_result(spark, once, {LONG: CASES[LONG]})[LONG].startswith("The committee")


def test_stream_of_a_table_of_many_files(spark, tmp_path):
    rows = [(i, f"One thing, {i} of them. Another one.") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(3).write.parquet(str(tmp_path / "documents.parquet.old"))
    stream = queries_jobs._stream(spark, str(tmp_path), "documents")
    out = str(tmp_path / "out")
    simplify_stream(stream, out, str(tmp_path / "state"), partitions=2).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_aligned_files_grow_in_number(spark, folder, monkeypatch):
    """Files of a bounded size: a larger table is cut into more of them, and the two folders at different rows."""
    parts, write = [], sources.write_csv
    monkeypatch.setattr(sources, "write_csv", lambda df, path: (parts.append(df.rdd.getNumPartitions()), write(df, path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert queries_jobs.aligned_files(spark, folder).count() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert min(parts) > 8 and parts[0] != parts[1]


def test_prompts_are_asked_in_bounded_pieces(spark, tmp_path):
    """A batch of many or of long prompts is asked piece by piece, in order, without its NULLs."""
    log = str(tmp_path / "log")

    def load():
        def call(prompts, budgets):
            with open(log, "a") as file:
                file.write(f"{len(prompts)} {sum(map(len, prompts))}\n")
            return [f"{p[:4]}-{b}" for p, b in zip(prompts, budgets)]
        return call

    number = F.col("id") + 1000
    long = F.when(F.col("id") < 40, F.repeat(F.lit("x"), 1 << 19)).otherwise("")
    df = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 10 != 0, F.concat(number.cast("string"), long)).alias("p"))
    found = generate(df, Generator(load), F.col("p"), F.col("id").cast("int")).select("id", "raw", "error").collect()
    assert [(r.id, r.raw, r.error) for r in found] == [(i, f"{i + 1000}-{i}" if i % 10 else None, None) for i in range(3000)]
    calls = [tuple(map(int, line.split())) for line in open(log)]
    assert sum(n for n, _ in calls) == 2700 and max(n for n, _ in calls) <= 1024 and max(size for _, size in calls) <= 4 << 20


def test_training_texts_are_cut_into_tokens_once(spark):
    """Not once for the number of parts and again for each part."""
    df = spark.createDataFrame([(1, "one two", "three")], "pair_id long, normal string, simple string")
    made = sources.training_tokens(df, lambda text: F.split(text, " "), "<pad>", 8)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert [r.part for r in made.collect()] == list(range(len(made.collect())))


def test_texts_are_folded_once_for_all_keys(spark):
    """The search for keys folds a sentence once, also inside an array; the result is that of the patterns alone."""
    df = spark.createDataFrame([("A rapid \u0130 manner. OF ALL Rapid things.",), (None,), ("",)], "text string")
    made = simplify_by_rule(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert [r.simplified for r in made.collect()] == ["A fast \u0130 way. OF ALL fast things.", None, ""]


def test_rows_stay_while_they_learn_their_positions(spark, tmp_path):
    """Two folders are put side by side by one shuffle of each; compressed ones give the same rows."""
    rows = spark.createDataFrame([(f"n{i}\n,\"", f" s{i}" if i % 3 else None, f"p{i} ") for i in range(40)], "Normal string, Simple string, Predicted string")
    for end in ("", ".gz"):
        pairs, told = f"{tmp_path}/pairs{end}", f"{tmp_path}/told{end}"
        sources.write_csv(rows.coalesce(1).select("Normal", "Simple"), pairs)
        sources.write_csv(rows.coalesce(1).select("Predicted"), told)
        assert all(name.endswith(f".csv{end}") for name in os.listdir(pairs) if name.startswith("part-"))
        read = sources.read_aligned(spark, pairs, told)
        assert sorted((r.pair_id, r.normal, r.simple, r.predicted) for r in read.collect()) == [(i, *r) for i, r in enumerate(rows.collect())]
        plan = read._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        # the only sort-merge join is that of the two sides; the counts of parts are sent to the rows
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2


def test_repeated_keys_stay_side_by_side(spark, tmp_path):
    """Sentences of documents that share a key have one order in both folders; no shuffle file of the writes is left."""
    docs = [(i // 3, "en", "a", " ".join(f"{w} {i} of {p}, and more {extraordinary}." for p, w in enumerate(("One", "Two", "Two")))) for i, extraordinary
            in enumerate(["extraordinarily", "x", ""] * 8)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(name, "false")
    found = queries_jobs.aligned_files(spark, str(tmp_path)).collect()
    assert spark.conf.get(name, "false") == usual
    assert len(found) == 72 and sorted(r.pair_id for r in found) == list(range(72))
    assert all(r.predicted == r.normal.split(",")[0] for r in found)
    assert all(int(a.normal.split()[1]) // 3 <= int(b.normal.split()[1]) // 3 for a, b in zip(*[sorted(found, key=lambda r: r.pair_id)[k:] for k in (0, 1)]))


def test_shuffles_of_written_stages_are_removed(spark, tmp_path):
    from clearlines.plans.staging import shuffles_removed

    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before = left()
    with shuffles_removed(spark):
        spark.range(1000).repartitionByRange(3, "id").write.parquet(f"{tmp_path}/a")
    assert not left() - before
    with pytest.raises(ValueError), shuffles_removed(spark):
        raise ValueError
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
