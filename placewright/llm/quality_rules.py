r"""Line-first quality rules (operator 6), DataFrame functions only.

Every line of a text is judged alone.  A line with a word fails if it

* shouts: it has capitals of any script, no small letters, and at least three words;
* is symbol-laden: characters of ``[#*$%&|<>]`` number at least 0.3 for each word;
* is navigation: three words or more of which at least a quarter are separators
  (``SEPARATORS``), or it is one of at least four short lines (up to three words,
  no terminal punctuation) that make up half or more of the text's distinct lines;
* lacks punctuation: eight words or more and no terminal punctuation of any
  script (``TERMINAL``);
* is boilerplate: it holds one of the fixed phrases below;
* repeats an earlier line of the same text.

Failed lines are removed.  A document is rejected where the removed lines hold
more than half of the characters of all lines with a word, or where the base
rules fail (fewer than 50 words, or more than half of the words in repeated
three-word windows).

Defined cases: a null or empty text has no words and is rejected by the base
rule; a null doc_id and repeated rows are kept as they are; other columns are
ignored; an empty table gives an empty result; nothing bounds a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SHORT_WORDS, SHORT_LINES = 3, 4
# Words that separate links, punctuation that ends or divides a sentence in some script.
SEPARATORS = tuple("| · • › » ❯ → > / ¦ ‖ ∙".split())
TERMINAL = ".!?:;…。．！？：；｡؟؛۔।॥।။၊։՞՜׃჻።፧፨᠃᠉។៕๏๚๛༎།‥‼⁇⁈⁉"
# Phrases of licence and site boilerplate, matched in any case.
PHRASES = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of service",
    "privacy policy",
    "accept cookies",
    "subscribe to our newsletter",
    "click here to",
    "tous droits réservés",
    "mentions légales",
    "politique de confidentialité",
    "accepter les cookies",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "allgemeine geschäftsbedingungen",
    "cookies akzeptieren",
    "todos los derechos reservados",
    "aviso legal",
    "política de privacidad",
    "aceptar cookies",
    "todos os direitos reservados",
    "tutti i diritti riservati",
    "все права защищены",
    "版权所有",
    "無断転載を禁じます",
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def described(line: Column) -> Column:
    """A line with what its rules read more than once."""
    return F.struct(line.alias("line"), F.lower(line).alias("low"), F.size(words(line)).alias("n"))


def _ends(line: Column) -> Column:
    """Whether terminal punctuation stands in a line; the long class is only tried on scripts that need it."""
    return line.rlike("[.!?:;…]") | (line.rlike("[^\\x00-\\u024F]") & line.rlike(f"[{TERMINAL}]"))


def _short(x: Column) -> Column:
    return (x["n"] <= SHORT_WORDS) & ~_ends(x["line"])


def line_fails(x: Column) -> Column:
    """Whether one described line (with a word) breaks a rule by itself."""
    line, low, n = x["line"], x["low"], x["n"]
    shouts = (n >= 3) & ~line.rlike("\\p{Ll}") & line.rlike("\\p{Lu}")
    laden = line.rlike("[#*$%&|<>]") & (_symbols(line) * 10 >= n * 3)
    bars = F.size(F.filter(words(line), lambda w: w.isin(*SEPARATORS)))
    menu = (n >= 3) & line.rlike("[" + "".join(SEPARATORS) + "]") & (bars * 4 >= n)
    unpunctuated = (n >= 8) & ~_ends(line)
    boiler = F.lit(False)
    for phrase in PHRASES:
        boiler = boiler | low.contains(phrase)
    return shouts | laden | menu | unpunctuated | boiler


def _window_hashes(w: Column) -> Column:
    """Hashes of the three-word windows of ``w``, in order."""
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(pairs, F.slice(w, 3, n - 2), lambda x, c: F.xxhash64(x["a"], x["b"], c))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, as sorted (hash, place).

    Windows are sorted with their place, so equal ones are neighbours; the places
    that have an equal neighbour are put back in order and each covers up to three
    words, fewer where the next one overlaps.  Only texts with a repeat are sorted.
    """
    keyed = F.sort_array(F.zip_with(hashes, F.sequence(F.lit(0), F.size(hashes) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), keyed)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row with the base measures of the contract."""
    text = F.coalesce(F.col("text"), F.lit(""))
    no_at = F.array().cast("array<int>")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    df = df.withColumn("w", words(text))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn("hashes", F.when(F.col("n_words") >= 4, _window_hashes(F.col("w"))))
    df = df.withColumn("keyed", _repeat_words(F.col("hashes")))
    n = F.size("keyed")
    df = df.withColumn(
        "at",
        F.when(
            n >= 2,
            F.array_sort(
                F.array_distinct(
                    F.flatten(
                        F.filter(
                            F.zip_with(
                                F.slice("keyed", 1, n - 1),
                                F.slice("keyed", 2, n - 1),
                                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
                            ),
                            lambda x: x.isNotNull(),
                        )
                    )
                )
            ),
        ).otherwise(no_at),
    )
    gaps = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("at") == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(
        "doc_id",
        "text",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _symbols(text).cast("long").alias("n_symbols"),
        covered.cast("long").alias("n_repeat_words"),
        lines.alias("lines"),
        "row",
    )
    df = df.withColumn("own_lines", F.array_distinct("lines"))
    return df.withColumn("n_dup_lines", (F.size("lines") - F.size("own_lines")).cast("long"))


def judge(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document, with the text of its good lines."""
    df = measures(docs)
    df = df.withColumn("seen", F.transform("own_lines", described))
    df = df.withColumn("fine", F.filter("seen", lambda x: ~line_fails(x)))
    # the state of the whole text stays outside the functions of single lines: inside it would be worked out for every line
    df = df.withColumn("short", F.size(F.filter("seen", _short)))
    listed = (F.col("short") >= SHORT_LINES) & (2 * F.col("short") >= F.size("seen"))
    df = df.withColumn("fine", F.when(listed, F.filter("fine", lambda x: ~_short(x))).otherwise(F.col("fine")))
    df = df.withColumn("good_lines", F.transform("fine", lambda x: x["line"]))

    def chars(name: str) -> Column:
        return F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + F.length(x))

    df = df.withColumn("all_chars", chars("lines")).withColumn("good_chars", chars("good_lines"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~base & (100 * (F.col("all_chars") - F.col("good_chars")) <= MAX_LOST_PERCENT * F.col("all_chars"))
    return df.select(
        "doc_id",
        "text",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        kept.alias("kept"),
        F.when(F.col("good_chars") == F.col("all_chars"), F.col("text")).otherwise(F.array_join("good_lines", "\n")).alias("clean_text"),
        "row",
    )


def clean(docs: DataFrame) -> DataFrame:
    """The rows that are kept, in the columns of ``docs``, without their failed lines.

    A text that loses no line stays as it is; n_chars, if there, counts the new text.
    """
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    row = F.struct(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
    # rows leave by an empty array, not by a filter: a filter would be pushed below
    # the projections and work out all their arrays once more, many times over
    return judge(docs).select(F.explode(F.when(F.col("kept"), F.array(row))).alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("text", "clean_text", "row")


def _verdict_sql() -> str:
    boiler = " or ".join(f"contains(lower(x), '{p}')" for p in PHRASES)
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    split = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')"
    nw = f"len({split.format('x')})"
    separators = ", ".join(f"'{v}'" for v in SEPARATORS)
    bars = f"len(list_filter({split.format('x')}, lambda v: v in ({separators})))"
    is_short = f"{nw} <= {SHORT_WORDS} and not regexp_matches(x, '[{TERMINAL}]')"
    return f"""
    with base as (
      select doc_id, coalesce(text, '') as t from documents
    ), worded as (
      select doc_id, t, {split.format('t')} as w,
             list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {spaces}, '')) > 0) as lines
      from base
    ), lined as (
      select *, list_filter(list_transform(range(1, len(lines) + 1), lambda i: case when list_position(lines, lines[i]) = i then lines[i] end), lambda x: x is not null) as own,
             case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) else [] end as tri
      from worded
    ), tris as (
      select rowid_ as r, unnest(tri) as g, generate_subscripts(tri, 1) as i from (select row_number() over () as rowid_, * from lined)
    ), numbered as (select row_number() over () as rowid_, * from lined),
    again as (
      select r, i, count(*) over (partition by r, g) as c from tris
    ), cover as (
      select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from again where c >= 2) group by r
    ), sorted as (
      select *, len(list_filter(own, lambda x: {is_short})) as short from numbered
    ), good as (
      select *, list_filter(own, lambda x: not (
            (short >= {SHORT_LINES} and 2 * short >= len(own) and {is_short})
         or (regexp_matches(x, '\\p{{Lu}}') and not regexp_matches(x, '\\p{{Ll}}') and {nw} >= 3)
         or ((length(x) - length(translate(x, '{SYMBOLS}', ''))) * 10 >= {nw} * 3)
         or ({nw} >= 3 and {bars} * 4 >= {nw})
         or ({nw} >= 8 and not regexp_matches(x, '[{TERMINAL}]'))
         or {boiler})) as fine
      from sorted
    ), figures as (
      select doc_id, cast(len(w) as bigint) as n_words,
             cast(length(translate(t, {spaces}, '')) as bigint) as word_chars,
             cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols,
             cast(len(lines) - len(own) as bigint) as n_dup_lines,
             cast(coalesce(cover.n, 0) as bigint) as n_repeat_words,
             coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) as all_chars,
             coalesce(list_sum(list_transform(fine, lambda x: length(x))), 0) as good_chars
      from good left join cover on cover.r = good.rowid_
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
           not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
             and 100 * (all_chars - good_chars) <= {MAX_LOST_PERCENT} * all_chars as kept
    from figures
    """


SQL = _verdict_sql()
