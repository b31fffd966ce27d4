"""Line-first cleaning with DataFrame functions only.

Every line of a text is judged by three rules, lines that fail are removed, and a document is
rejected if it loses too much or its words fail the base rules. All of it is one projection of a
scan: no shuffle, no Python.

Defined results: a null text has no words and is rejected (its cleaned text is null); lines
without a word are kept as they are but never count; repeated rows are judged alike; columns
named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.llm.common import SPACE, WORD, without

#: Ends of a sentence, closing quotes and brackets after them allowed.
ENDED = r"[.!?:;…。！？।؟][\"')\]»”’]*[\x20\x09-\x0D]*\z"
#: A line of so many words that holds an end of a sentence is a paragraph that was cut off, not a fragment.
PARAGRAPH = 30
INNER_END = r"[.!?…。！？।؟][\"')\]»”’]*[\x20\x09-\x0D]"
#: Between the entries of a menu or a trail of links.
BETWEEN = r"[|>»›•·]"
SHOUTS = r"[!?*#~=_^]"
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie (policy|settings|consent)|(uses|use|accept) (all )?cookies|privacy policy|terms (of|and) (use|service|conditions)"
    r"|(enable|requires) javascript|click here|sign (in|up)|log ?in (to|or)|subscribe (to|now)|skip to (main )?content|read more|add to cart"
    r"|^(licensed|released) under|this work is licensed|copyright (\(c\)|©)"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|cookie-(einstellungen|richtlinie)|(verwendet|akzeptieren) cookies|nutzungsbedingungen|hier klicken"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|(utilise|accepter) (des|les) cookies|conditions (d['’]utilisation|g[éÉ]n[éÉ]rales de vente)|cliquez ici"
    r"|todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|(utiliza|usa|aceptar) (las )?cookies|t[éÉ]rminos y condiciones|haga clic aqu[íÍ])"
)
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
#: Percent of the words that failing lines may hold.
MAX_LOST = 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def n_words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def fails_punctuation(line: Column) -> Column:
    """No end of a sentence (a paragraph may have it inside), or more than one mark like ! ? * # for every two words."""
    shouts = F.regexp_count(line, F.lit(SHOUTS))
    unended = ~F.rlike(line, F.lit(ENDED)) & ~(F.rlike(line, F.lit(INNER_END)) & (n_words_in(line) >= PARAGRAPH))
    return unended | (shouts > 1) & (2 * shouts > n_words_in(line))


def fails_navigation(line: Column) -> Column:
    """Two or more separators, with under four words for each part."""
    parts = F.regexp_count(line, F.lit(BETWEEN))
    return (parts >= 2) & (n_words_in(line) < 5 * (parts + 1))


def fails_boilerplate(line: Column) -> Column:
    return (n_words_in(line) <= 30) & F.rlike(line, F.lit(BOILERPLATE))


def line_passes(line: Column) -> Column:
    return ~(fails_navigation(line) | fails_boilerplate(line) | fails_punctuation(line))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more, its first place included.

    Windows are compared by hash; only texts that hold a repeated window are sorted.
    """
    n = F.size(words)
    hashes = F.when(
        n > WINDOW,
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))),
    )

    def covered(starts: Column) -> Column:
        """The size of the union of windows that begin at these sorted places."""
        gaps = F.transform(starts, lambda s, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), s - F.get(starts, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def places(h: Column) -> Column:
        """Starts of the windows that have an equal one."""
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twin = lambda s, x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: twin(s, x, j)), lambda x: x["i"])))

    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(F.lit(0)))
    return F.coalesce(count, F.lit(0)).cast("long")


def only_kept(judged: DataFrame) -> DataFrame:
    """The kept rows of ``judge``'s result. The row number is a barrier: without it the filter would go below the verdict and compute it anew."""
    at = F.monotonically_increasing_id()
    return judged.withColumn("__tw_at", at).filter((F.col("__tw_at") >= 0) & F.col("kept")).drop("__tw_at")


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "clean_text", "kept")


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with OUTPUTS: the measures (long), ``base_failed``, ``clean_text`` (the text without
    its failing lines) and ``kept``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n", -1)
    has_word = lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))
    lost_in = lambda x: F.when(line_passes(x), F.lit(0)).otherwise(n_words_in(x))
    judged = let(lines, lambda ls: F.transform(ls, lambda x: F.struct(x.alias("line"), F.when(has_word(x), lost_in(x)).otherwise(F.lit(0)).alias("lost"))))
    base = without(df, *(o for o in OUTPUTS if o != text))
    step = base.withColumn("__tw_words", words_of(whole)).withColumn("__tw_lines", judged)
    kept_lines = F.transform(F.filter("__tw_lines", lambda x: x["lost"] == 0), lambda x: x["line"])
    full = F.transform(F.filter("__tw_lines", lambda x: has_word(x["line"])), lambda x: x["line"])
    step = (
        step.withColumn("n_words", F.size("__tw_words").cast("long"))
        .withColumn("word_chars", (F.length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("__tw_words")))
        .withColumn("lost_words", F.aggregate("__tw_lines", F.lit(0), lambda a, x: a + x["lost"]).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
        .withColumn("clean_text", F.when(F.col(text).isNotNull(), F.concat_ws("\n", kept_lines)))
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= MAX_LOST * F.col("n_words")))
    )
    return step.drop("__tw_words", "__tw_lines")
