import re
from collections import Counter

from terraweave.llm import line_quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three. " * 12),
    (5, "a b c d e f g h i j. k l m n o p q r s t u v w."),
    (6, "Home | About | News\nAll rights reserved.\n" + "Plain words stand in this line of text, one after one.\n" * 1),
    (7, "x\nx\n\n\ny # $ <\nx"),
    (8, "word " * 30000),
    (8, "word " * 30000),
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def columns(df):
    return df.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_measures_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "own") for i, t in TEXTS], "doc_id long, text string, KEPT string")
    got = line_quality.judge(df).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(TEXTS)
    for row in got:
        assert tuple(row)[2:8] == brute(row.text), row.doc_id
        assert not (row.base_failed and row.kept)


def test_failing_lines_go(spark):
    good = "Plain words stand in this line of text, one after one."
    other = "Quite different things are said by this second line, which also ends well."
    text = f"Home | About | News\n{good}\nAll rights reserved.\n{other}"
    df = spark.createDataFrame([(1, text), (2, "Home | About | News | Shop\n" * 9 + good)], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_quality.judge(df).collect()}
    assert rows[1].clean_text == f"{good}\n{other}" and rows[1].kept
    assert not rows[2].kept


def test_boilerplate_of_four_languages(spark):
    lines = ["Alle Rechte vorbehalten.", "Unsere DATENSCHUTZERKLÄRUNG gilt.", "Tous droits réservés.", "Voir les conditions d’utilisation.", "Todos los derechos reservados.", "Política de cookies.", "We accept all cookies."]
    clean = ["Der Datenschutz ist ihm wichtig.", "Elle voulait lire la suite.", "Los derechos de todos cuentan."]
    df = spark.createDataFrame([(1, "\n".join(lines + clean + ["They sign in " + "plain words " * 20 + "here."]))], "doc_id long, text string")
    assert line_quality.judge(df).first().clean_text.split("\n")[:-1] == clean


def test_a_paragraph_may_end_anywhere(spark):
    inside = "Plain words stand in this line of text, one after one. " * 4
    df = spark.createDataFrame([(1, inside + "and then it"), (2, "no mark at all " * 20), (3, "Short. but cut\n" * 9)], "doc_id long, text string")
    lost = {r.doc_id: r.lost_words for r in line_quality.judge(df).collect()}
    assert lost == {1: 0, 2: 80, 3: 27}


def test_only_kept_keeps_the_same_rows(spark):
    judged = line_quality.judge(queries.table(spark, SF, "documents").select("doc_id", "text"))
    kept = line_quality.only_kept(judged)
    assert kept.columns == judged.columns and sorted(kept.select("doc_id").collect()) == sorted(judged.filter("kept").select("doc_id").collect())


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op5_line_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


def test_empty_table(spark):
    assert line_quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
