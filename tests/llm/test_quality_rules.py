import pandas as pd

from placewright.llm import quality_rules as Q

from . import duck

SF = "/root/testdata/sf0.001"
CLEAN = "\n".join(" ".join(f"w{i}x{k}" for k in range(9)) + f", and {i} ends." for i in range(12))
TEXTS = [
    None,
    "",
    "  \n\t \n",
    CLEAN,
    CLEAN + "\nAll rights reserved.\nhome | news | about | help",
    CLEAN.upper(),
    "\n".join("home | news | about | help | contact | login" for _ in range(30)),
    "same words here " * 60,
    "Same line ends here.\n" * 40,
    CLEAN.replace(" ", "### "),
    "äöü ß\u00a0x y\x0bz\x1fq " * 30,
    "a b c a b c",
    "a a a a a a " * 20,
    "\n".join(" ".join(f"शब्द{i}क{k}" for k in range(10)) + " ।" for i in range(12)),
    "\n".join(" ".join(f"слово{i}и{k}" for k in range(10)) + "." for i in range(12)),
    "\n".join(" ".join(f"СЛОВО{i}И{k}" for k in range(10)) + "." for i in range(12)),
    "\n".join(" ".join(f"词{i}语{k}" for k in range(10)) + "。" for i in range(12)),
    CLEAN + "\n" + "\n".join(f"link {i}" for i in range(40)) + "\nHome › News › More",
    "\n".join(f"Menu item {i}" for i in range(40)),
    "x\x1fy z " * 30,
]


def test_against_sql_on_the_table(spark):
    assert duck.spark_rows(Q.op6_quality_rules(spark, SF)) == duck.rows(Q.SQL, SF)


def test_against_sql_on_odd_texts(spark):
    frame = pd.DataFrame({"doc_id": [*range(len(TEXTS)), 3, None], "text": [*TEXTS, TEXTS[3], "x y"]}).astype({"doc_id": "Int64"})
    docs = spark.createDataFrame([(None if pd.isna(i) else int(i), t, 5, "w") for i, t in zip(frame.doc_id, frame.text)], "doc_id long, text string, n_words int, lines string")
    got = duck.spark_rows(Q.judge(docs).drop("text", "clean_text", "row"))
    assert got == duck.rows(Q.SQL, documents=frame)
    kept = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    assert kept[3] and kept[4] and not any(kept[i] for i in (0, 1, 2, 5, 6, 7, 8, 9))
    assert kept[13] and kept[14] and not kept[15] and kept[16] and not kept[18]
    text = {r.doc_id: r.clean_text for r in Q.judge(docs).collect()}
    assert text[17] == CLEAN and kept[17]


def test_very_long_text(spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(9)) + "." for i in range(60_000))
    row = Q.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.kept and row.n_words == 540_000 and row.clean_text == text


def test_brute_force_of_repeated_words(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.judge(docs).collect():
        w = texts[r.doc_id].split()
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
        assert r.n_repeat_words == len(hit)


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = Q.op6_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", -1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, row string, n_chars long")
    got = {r.doc_id: r for r in Q.clean(docs).collect()}
    assert Q.clean(docs).columns == docs.columns
    assert got[3].text == CLEAN and got[4].text == CLEAN and got[4].n_chars == len(CLEAN) and got[4].row == "s"
    assert 0 not in got and 6 not in got
