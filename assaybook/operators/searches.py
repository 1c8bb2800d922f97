"""Many searches at once, as rows: one n-gram of each search proposes texts, the exact pattern confirms.

A search is a text that any of some columns must hold, case-blind, with live % and _ (see functions.text). Work is done on
distinct texts, not on rows: a name that many rows share is looked up once. Each literal stretch of a search gives n-grams
as long as it allows (SIZES). The texts' n-grams that occur in any search are counted, each search keeps its
rarest one, and only places of kept n-grams are joined with the searches and confirmed with the whole pattern. Searches and
texts meet nowhere else, so no pairs of all are built, and a long literal is never looked up by a short, frequent n-gram.
A search without any literal character (blank, or % and _ only) asks for a least length and is joined by length.

Most n-grams of the texts are in no search. A table of bits of fixed size keeps them out of the shuffle; those that it lets
through by chance are dropped by the joins, so results don't depend on it.

Hot n-grams: places are the left side of their join and the other side is stored first, so Spark's run-time split
cuts an n-gram that a large part of all texts hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import list_limit
from ..functions.text import digits_only, is_phone_query, owner_key, pet_key, trim
from ..session import stored as _stored
from .directory import PET_FIELDS
from .lists import LIST_COLUMNS, SEARCHED

GRAM = 3
#: Lengths of the n-grams that texts are looked up by.
SIZES = (1, 2, 3, 4, 5, 6, 8, 12)
#: The table of bits: 2^ROW_BITS rows of 2^ROW_BITS words of 64 bits.
ROW_BITS = 10


def pattern_column(q: Column) -> Column:
    """functions.text.like_pattern of a column: '%q%', lower case, backslashes before %, _ or another one kept,
    others dropped."""
    whole = F.concat(F.lit("%"), F.lower(q), F.lit("%"))
    return F.regexp_replace(whole, r"\\([^%_\\])|(\\[%_\\])", "$1$2")


def _literals(pattern: Column) -> Column:
    """Stretches of a pattern that stand in every text that matches: what lies between its wildcards."""
    stretches = F.regexp_extract_all(pattern, F.lit(r"(?:\\[%_\\]|[^%_\\])+"), 0)
    return F.transform(stretches, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))


def _grams(text: Column, n: Column) -> Column:
    return F.when(
        F.length(text) >= n,
        F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n)),
    ).otherwise(F.array().cast("array<string>"))


def prepare(searches: DataFrame, q: str = "q", key: str = "query_no", sizes: Sequence[int] | None = None) -> DataFrame:
    """query_no, pattern, and its n-grams: of each stretch, of the largest of the sizes that it allows (without sizes: those of
    three characters if any stretch is long enough, else of two or one); least_length is what a pattern without a literal
    character asks for. Other columns of searches are kept."""
    parts = F.filter(_literals(F.col("pattern")), lambda x: F.length(x) > 0)
    kept = [c for c in searches.columns if c not in (q, key)]
    rows = searches.select(
        F.col(key).alias("query_no"), pattern_column(trim(F.coalesce(F.col(q), F.lit("")))).alias("pattern"), *kept
    ).select("*", parts.alias("parts"))
    rows = rows.withColumn("n", F.least(F.coalesce(F.array_max(F.transform("parts", F.length)), F.lit(0)), F.lit(GRAM)))

    def size(part: Column) -> Column:
        if sizes is None:
            return F.col("n")
        return reduce(lambda other, k: F.when(F.length(part) >= k, k).otherwise(other), sorted(sizes), F.lit(1))

    grams = F.flatten(F.transform("parts", lambda x: _grams(x, size(x))))
    return rows.select(
        "query_no", "pattern", *kept, F.when(F.col("n") > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>")).alias("grams"),
        (F.length("pattern") - F.length(F.replace(F.col("pattern"), F.lit("_"), F.lit("")))).alias("least_length"),
    )


def _bit(gram: Column) -> tuple[Column, Column]:
    """(word, place in it) of an n-gram in the table of bits."""
    h = F.xxhash64(gram)
    return F.pmod(F.shiftright(h, 6), F.lit(1 << 2 * ROW_BITS)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def _bits(grams: DataFrame) -> Column:
    """The bits of all n-grams (gram) as rows of words: a scalar of 8 MB, however many n-grams there are."""
    word, place = _bit(F.col("gram"))
    words = grams.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place).alias("bits"))
    every = grams.sparkSession.range(1 << 2 * ROW_BITS).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = words.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def listed(rows: DataFrame, place: str, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value])

    rows = words.withColumn("row", F.shiftright("word", ROW_BITS)).groupBy("row").agg(listed(words, "word", "bits").alias("words"))
    return rows.agg(listed(rows, "row", "words").alias("rows")).scalar()


def text_places(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, gram) of the n-grams of distinct texts, each once a text: those wanted (gram), and a few others."""
    size = F.length("text")
    places = texts.select("text", F.explode(F.sequence(F.lit(1), size)).alias("at")).select(
        "text", "at", F.explode(F.array(*map(F.lit, SIZES))).alias("n")
    ).filter(F.col("at") + F.col("n") - 1 <= size)
    rows = places.select("text", "at", F.substring("text", F.col("at"), F.col("n")).alias("gram"))
    word, place = _bit(F.col("gram"))
    held = F.get(F.get(_bits(wanted), F.shiftright(word, ROW_BITS)), word.bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    asked = F.call_function("shiftright", held, place).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return rows.filter(asked).filter(F.instr("text", F.col("gram")) == F.col("at")).select("text", "gram")


def matches(df: DataFrame, searches: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """(query_no, id) of all rows of df with a column that a search matches. searches(query_no, q); ids are unique. Other
    columns of searches are kept. Rows come dealt by id."""
    asked = _stored(prepare(searches, sizes=SIZES), "searches")
    kept = [c for c in asked.columns if c not in ("query_no", "pattern", "grams", "least_length")]
    each = asked.select("query_no", F.explode("grams").alias("gram"))
    cells = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.array(
        *[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    ))).alias("text")).filter(F.col("text") != "")
    texts = _stored(cells.select("text").distinct(), "texts")
    counts = text_places(texts, each).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a search with a gram that no text has finds nothing
    rarest = each.join(counts, "gram", "left").groupBy("query_no").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")
    ).filter(F.col("best.n") > 0).select("query_no", F.col("best.gram").alias("gram"))
    chosen = _stored(rarest.join(asked.select("query_no", "pattern", *kept), "query_no"), "chosen-grams")
    proposed = text_places(texts, chosen).join(chosen, "gram")
    found = _stored(proposed.filter(F.like("text", F.col("pattern"))).select("text", "query_no", *kept), "found-texts")
    # a row may hold two texts that a search matches
    rows = cells.join(found, "text").select("query_no", "id", *kept).unionByName(
        _by_length(df, asked.filter(F.size("grams") == 0).select("query_no", "pattern", "least_length", *kept), columns, id_col)
    )
    return rows.repartition("id").distinct()


def _by_length(df: DataFrame, open_searches: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """Matches of searches that ask for a length only; a blank search finds every row."""
    asked = open_searches.withColumn(
        "at_least", F.when(F.col("pattern") == "%%", -1).otherwise(F.col("least_length")).cast("int")
    ).drop("pattern", "least_length")
    longest = F.coalesce(F.greatest(*[F.length(c) for c in columns], F.lit(None).cast("int")), F.lit(-1))
    rows = df.select(F.col(id_col).alias("id"), longest.alias("longest"))
    # the lengths that occur are few: what each of them answers is worked out once
    answers = rows.select("longest").distinct().select(
        "longest", F.explode(F.sequence(F.lit(-1), F.col("longest"))).alias("at_least")
    ).join(asked, "at_least").drop("at_least")
    return rows.join(_stored(answers, "lengths"), "longest").drop("longest")


def _questions(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is asked, each once, with a number of its own as query_no; who asks for it: query_no, question, alone). alone is
    false where a query_no comes with several texts. searches(query_no, q) may repeat; other columns belong to the text."""
    kept = [c for c in searches.columns if c not in ("query_no", "q")]
    said = searches.select("query_no", F.lower(trim(F.coalesce(F.col("q"), F.lit("")))).alias("q"), *kept).distinct()
    said = _stored(said.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("query_no")) == 1), "said")
    asked = said.select("q", *kept).distinct().withColumn("question", F.monotonically_increasing_id())
    # numbers are fixed once they are stored
    asked = _stored(asked, "questions")
    same = reduce(Column.__and__, [said[c].eqNullSafe(asked[c]) for c in ("q", *kept)])
    askers = said.join(asked, same).select(said["query_no"], "question", "alone")
    return asked.withColumnRenamed("question", "query_no"), _stored(askers, "askers")


def _any_shared(askers: DataFrame) -> bool:
    """Does a query_no come with several texts?"""
    return not askers.filter(~F.col("alone")).isEmpty()


def report_list_searches(
    reports: DataFrame, searches: DataFrame, limit: str | int | None = None
) -> DataFrame:
    """report_list for searches(query_no, q) as rows: every match, or the newest `limit` of each with its position."""
    n = list_limit(limit)
    questions, askers = _questions(searches)
    found = matches(reports, questions, SEARCHED).withColumnRenamed("query_no", "question")
    listed = reports.select(*LIST_COLUMNS)
    one, shared = askers.filter("alone").drop("alone"), askers.filter(~F.col("alone")).drop("alone")
    if n is None:
        # the answers to a search are as many as its askers times its reports: that product travels no more
        rows = found.join(listed, "id").join(one, "question").select(*LIST_COLUMNS, "query_no")
        if _any_shared(askers):
            ids = found.join(shared, "question").select("query_no", "id").distinct()
            rows = rows.unionByName(ids.join(listed, "id").select(*LIST_COLUMNS, "query_no"))
        return rows

    def newest(rows: DataFrame, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id")))
        return rows.withColumn("position", place).filter(F.col("position") <= n)

    top = newest(found.select("question", "id"), "question")
    rows = top.join(one, "question").select("query_no", "id", "position")
    if _any_shared(askers):
        ids = top.join(shared, "question").select("query_no", "id").distinct()
        rows = rows.unionByName(newest(ids, "query_no"))
    return rows.join(listed, "id").select(*LIST_COLUMNS, "query_no", "position")


def _found_directory(found: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Owners and pets of found(key, id, phone), one row per pet."""
    rows = found.join(reports, "id").filter(
        F.col("phone").isNull() | F.contains(digits_only(F.col("owner_phone")), F.col("phone"))
    )
    rows = rows.select(
        key, owner_key(F.col("owner_phone"), F.col("patient_name")).alias("owner_key"),
        pet_key(F.col("pet_name"), F.col("id")).alias("pet_key"), *reports.columns,
    )
    texts = ("patient_name", "owner_phone", "referring_vet")

    def known(c: str) -> Column:
        return F.when(F.nullif(c, F.lit("")).isNotNull(), F.struct("id", F.col(c).alias("text")))

    # hits are read once: what an owner needs of them is kept with its pets
    newest = F.max_by(F.struct(*PET_FIELDS, "report_date"), "id")
    pets = _stored(rows.groupBy(key, "owner_key", "pet_key").agg(
        newest.alias("_p"), F.max("id").alias("last_report_id"), *[F.max(known(c)).alias(f"_{c}") for c in texts]
    ), "found-pets")
    owners = pets.groupBy(key, "owner_key").agg(
        *[F.coalesce(F.max(f"_{c}")["text"], F.lit("")).alias(c) for c in texts],
        F.max("last_report_id").alias("owner_last_report_id"),
    )
    return pets.select(key, "owner_key", "pet_key", "_p", "last_report_id").join(owners, [key, "owner_key"]).select(
        key, "owner_key", "patient_name", "owner_phone", "referring_vet", "owner_last_report_id", "pet_key",
        *[F.coalesce(F.col(f"_p.{c}"), F.lit("")).alias(c) for c in PET_FIELDS],
        "last_report_id", F.col("_p.report_date").alias("last_report_date"),
    )


def patient_searches(reports: DataFrame, searches: DataFrame) -> DataFrame:
    """patient_search for searches(query_no, q) as rows: + query_no. A search with seven digits or more looks for them
    among phone numbers; a blank one finds nothing."""
    q = trim(F.coalesce(F.col("q"), F.lit("")))
    phone = is_phone_query(q)
    asked = searches.select("query_no", q.alias("q")).filter(F.col("q") != "").select(
        "query_no", F.when(is_phone_query(F.col("q")), digits_only(F.col("q"))).alias("phone"),
        F.when(phone, digits_only(F.col("q"))).otherwise(F.col("q")).alias("q"),
    )
    questions, askers = _questions(asked)
    found = matches(reports, questions, ("owner_phone", "patient_name", "pet_name")).withColumnRenamed("query_no", "question")
    one, shared = askers.filter("alone").drop("alone"), askers.filter(~F.col("alone")).drop("alone")
    # a search is answered once, whoever asks for it
    answers = _found_directory(found, reports, "question")
    columns = ["query_no", *[c for c in answers.columns if c != "question"]]
    rows = answers.join(one, "question").select(*columns)
    if _any_shared(askers):
        ids = found.join(shared, "question").select("query_no", "id", "phone").distinct()
        rows = rows.unionByName(_found_directory(ids, reports, "query_no"))
    return rows
