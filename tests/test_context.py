import pytest
from pyspark.sql import functions as F

from lectern import fixed
from lectern.operators import completion, context, embedding
from lectern.sources import versions

SCHEMA = (
    "query_id int, rank int, item_id string, type string, text string, section_title string, university_id string, "
    "program string, year string, source_file string, table_html string, score double, rerank_score double"
)


def hit(rank, text, section="S", source="a_b.md", score=0.5, rerank=None, kind="chunk", html=None):
    return (1, rank, f"i{rank}", kind, text, section, f"U{rank}", "P", "2024", source, html, score, rerank)


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA).repartition(2)


def test_context_layout(spark):
    df = hits(spark, hit(2, "second", kind="table", html="<table></table>"), hit(1, "first"))
    row = context.assemble_context(df).first()
    one, two = row["context"].split(f"\n\n{'=' * 50}\n\n")
    assert one == f"[1] 🏫 UNIVERSITY: U1\n📚 Program: P\n📄 Source: a_b.md\n📑 Section: S\n{'-' * 40}\nfirst"
    assert two.endswith("second\n\nTable:\n<table></table>")
    assert row["num_sources"] == 2
    bare = context.assemble_context(df, include_metadata=False, include_citations=False).first()["context"]
    assert bare.startswith(" first")


def test_context_budget(spark):
    df = hits(spark, *[hit(i, "w " * 10) for i in range(1, 5)])
    row = context.assemble_context(df, include_metadata=False, max_tokens=25).first()
    assert row["num_sources"] == 2


def test_citations(spark):
    df = hits(
        spark,
        hit(1, "x" * 500, rerank=0.2),
        hit(2, "two", rerank=0.9),
        hit(3, "three", rerank=0.4),
        hit(4, "1.2. Grading Policy rules\nbody", section="", rerank=0.1),
        hit(5, "other", source="z.md", score=-0.5),
    )
    first, second = context.citations(df).orderBy("id").collect()
    assert (first["source_file"], first["university_id"], first["chunk_count"], first["score"]) == ("a_b.md", "U1", 4, 0.9)
    assert first["sections"] == ["1.2. Grading Policy rules", "S"]
    assert first["text"].startswith("📄 a b.pdf\n🏫 U1 | 📚 P | 📅 2024\n\n" + "=" * 60)
    assert "two\n\nthree\n\n[... and 1 more passage(s) from this section]" in first["text"]
    assert "x" * 400 not in first["text"]  # third best of its section
    assert second["score"] == -0.5
    assert context.citations(df, floor=0.0).filter("source_file = 'z.md'").first()["score"] == 0.0


def test_section_titles(spark):
    rows = [
        ("given", "Given"),
        ("3. STUDENT AFFAIRS here\nx", None),
        ("intro line that is long enough to be ordinary text\nALL CAPS TITLE\nx", ""),
        ("A. Overview\nx", "Unknown"),
        ("nothing", ""),
    ]
    df = spark.createDataFrame(rows, "text string, section_title string")
    found = [r["section_title"] for r in context.infer_section(df).collect()]
    assert found == ["Given", "3. STUDENT AFFAIRS here", "ALL CAPS TITLE", "A. Overview", "Document Content"]


def test_prompts(spark):
    rows = [("q {context}", "c {question}", "qa", "en"), ("q", "c", "odd", "fr"), ("q", "c", "summary", "ar"), ("q", "c", None, None)]
    df = spark.createDataFrame(rows, "question string, context string, question_type string, language string")
    found = [r["prompt"] for r in context.build_prompts(df).collect()]
    expected = fixed.PROMPT_TEMPLATES[("qa", "en")]
    # Inserted text is not searched for placeholders.
    assert "Context:\nc {question}\n\nQuestion: q {context}\n" in found[0]
    assert found[1] == found[3] == expected.replace("{context}", "c").replace("{question}", "q")
    assert found[2] == fixed.PROMPT_TEMPLATES[("summary", "ar")].replace("{context}", "c").replace("{question}", "q")
    extra = context.build_prompts(df, instructions="Be brief").first()["prompt"]
    assert "Instructions:\nBe brief\n-\n- Answer" in extra


def test_conversation_window(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(8)]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    questions = spark.createDataFrame([(1, "now?"), (2, "alone?")], "conv_id int, question string")
    found = {r["conv_id"]: r["question_with_context"] for r in context.conversation_context(messages, questions).collect()}
    assert found[1].startswith("Previous conversation:\nUser: m2\nAssistant: m3\n")
    assert found[1].endswith("Assistant: m7\n\nCurrent question:\nnow?")
    assert found[2] == "alone?"
    before = {r["turn"]: r["history"] for r in context.running_history(messages, 2).collect()}
    assert before[0] == "" and before[3] == "Assistant: m1\nUser: m2\n"


def test_completion_runs_once_per_prompt_and_falls_back(spark):
    def load():
        def run(prompts):
            if "bad" in prompts:
                raise RuntimeError
            return [f"{p}!{len(prompts)}" for p in prompts]

        return run

    df = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "p string")
    done = completion.complete(df, "p", load, F.lit("fallback"), batch_size=1).collect()
    assert sorted(r["completion"] for r in done) == ["a!1", "a!1", "fallback", "fallback"]
    assert completion.complete(df, "p").filter("p = 'a'").first()["completion"] == "a."


def test_answers_keep_questions_without_hits(spark):
    chunks = spark.createDataFrame(
        [("c1", "The cat sat. It slept.", "U", "P", "2024", "f.md", "S")],
        "item_id string, text string, university_id string, program string, year string, source_file string, section_title string",
    )
    sources = {"chunk": embedding.embed(chunks)}
    questions = spark.createDataFrame([(1, "cat?"), (2, "dog?")], "query_id int, text string")
    asked = embedding.embed(questions).withColumn("embedding", F.when(F.col("query_id") == 1, F.col("embedding")))
    found = {r["query_id"]: r for r in completion.answer_batch(asked, sources).collect()}
    assert found[1]["answer"] == "The cat sat." and found[1]["num_sources"] == 1
    assert found[1]["citations"][0]["source_file"] == "f.md"
    assert found[2]["answer"] == "No relevant information found." and found[2]["num_sources"] == 0


def test_map_items(spark):
    doubled = completion.map_items(spark.range(5), lambda pdf: pdf.assign(id=pdf["id"] * 2), "id long")
    assert sorted(r["id"] for r in doubled.collect()) == [0, 2, 4, 6, 8]


def test_a_failing_prompt_leaves_the_others_their_answers(spark):
    df = spark.createDataFrame([(i, "bad" if i % 16 == 3 else f"p{i}") for i in range(64)], "id int, p string").coalesce(1)

    def load():
        def ask(prompts):
            if "bad" in prompts:
                raise RuntimeError
            return [p + "!" for p in prompts]

        return ask

    done = completion.complete(df, "p", load, F.lit("fallback"), failed="failed").collect()
    assert all(r["completion"] == ("fallback" if r["p"] == "bad" else r["p"] + "!") for r in done)
    assert {r["p"] for r in done if r["failed"]} == {"bad"} and sum(r["failed"] for r in done) == 4


def test_a_prompt_shared_by_most_rows_is_asked_once(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("p"))

    def load():
        return lambda prompts: [f"{p} {prompts.count(p)}" for p in prompts]

    done = completion.complete(df, "p", load).filter("p = 'hot'")
    assert done.count() == 2000 and done.select("completion").distinct().collect()[0][0] == "hot 1"


def test_a_second_run_asks_new_prompts_alone(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")

    def load():
        def ask(prompts):
            with calls.open("a") as log:
                log.writelines(f"{p}\n" for p in prompts)
            if "bad" in prompts:
                raise RuntimeError("no")
            return ["" if p == "blank" else p + "!" for p in prompts]

        return ask

    def run(prompts, model="m", **options):
        calls.write_text("")
        df = spark.createDataFrame([(p,) for p in prompts], "p string")
        done = completion.complete_stored(df, "p", load, store, model, F.lit("none"), batch_size=1, reused="old", **options)
        return sorted((r.p or "", r.completion, r.old) for r in done.collect()), sorted(calls.read_text().split())

    first = run(["a", "a", "b", "bad", "blank", None])
    assert first == ([("", "none", False), ("a", "a!", False), ("a", "a!", False), ("b", "b!", False), ("bad", "none", False), ("blank", "none", False)], ["a", "b", "bad", "blank"])
    assert run(["a", "b", "c", "blank"]) == ([("a", "a!", True), ("b", "b!", True), ("blank", "none", True), ("c", "c!", False)], ["c"])
    assert run(["a", "bad"]) == ([("a", "a!", True), ("bad", "none", False)], ["bad"])
    assert run(["a"], model="other") == ([("a", "a!", False)], ["a"])
    # Parts are written into one where there are many; nothing is asked again.
    assert run(["d"], parts=2)[1] == ["d"] and len(versions.manifest(spark, store)["tables"]) == 1
    assert run(["a", "b", "c", "d", "blank"])[1] == []


def test_a_failed_load_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    df, store = spark.createDataFrame([("a",)], "p string"), str(tmp_path / "store")

    def load():
        return lambda prompts: [p + "!" for p in prompts]

    with monkeypatch.context() as m:
        m.setattr(versions._Files, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            completion.complete_stored(df, "p", load, store, "m")
    assert completion.read_answers(spark, store).count() == 0
    assert completion.complete_stored(df, "p", load, store, "m").head().completion == "a!"
    assert completion.read_answers(spark, store).count() == 1
