"""Texts that stop inside a word or a sentence, found by counting word trigrams inside lines versus at their ends, in SQL.

A trigram that is common inside lines and almost never at an end is no way to end a page: a text whose last trigram is one was
cut. Numbers and capitalised words count as one word each, so that names do not make every trigram rare; a line's start counts as part of
its first trigrams. Ends of long lines are counted apart: words that close a tag or a byline need not be a way to end a paragraph.

A last word that was itself cut is no known word: then the trigram before it decides, by how often at most one word follows it. A word that
was cut may itself be seen often, if many pages are cut alike; it is known by a longer word that starts with it and follows the same two words far more
often. If no trigram tells, a text was cut if something stands behind the cut or its last line is a long one, as such lines hardly ever
end without a full stop.

Pages are counted, not rows: copies of one page (fetched again, mirrored under another menu) weigh one together, else a cut page that stands
often would make its own last trigram a usual end.

An exact check follows: a text whose last line ends with a full stop, is a list entry or has a label in front was not cut inside a
sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.session import materialize

SUPPORT = 4  # least times that a trigram is seen elsewhere to decide
AT_END = 0.2  # largest share of ends of a trigram that is no way to end
LONG = 30  # least words and marks of a long line
BROADCAST_ROWS = 300_000  # of three numbers, or a number and four flags
HEAVY = 1000  # copies of a page from which they are never shuffled by page, so that no task gets them all

# fixed values: what is put behind a cut, or is left of markup that was cut; how a sentence ends; how a list
# entry and a line with a label (byline, tags, credit) begin
MARKS = r"(\\s*(…|\\.\\.\\.|\\[\\s*(…|\\.\\.\\.)\\s*\\]|&#?[A-Za-z0-9]{0,8}|<[^<>]{0,300}|�))+$"
SENTENCE_END = r"[.!?。！？।]\\s*[\"”“»«\'’‘›)\\]Ââ€]*\\s*\\.?$"
LABEL = r"^\\p{Lu}[\\p{L}\\p{M}\\p{S}-]*(\\s[\\p{L}\\p{M}\\p{S}-]+)?\\s?:\\s.{1,80}$"
LIST_ENTRY = r"^\\s*([-*•·–▪]|\\d+[.)])\\s"
TOKEN = r"[\\p{Ll}\\p{Lo}\\p{M}\'’]+(-[\\p{Ll}\\p{Lo}\\p{M}\'’]+)*|[\\n0X]|[^\\s\\p{L}]"


def _tokens(column: str) -> str:
    """SQL: the words of a text with numbers as 0, capitalised words as X and line breaks as words."""
    plain = f"regexp_replace(regexp_replace({column}, '\\\\p{{N}}+', '0'), '\\\\p{{Lu}}[\\\\p{{L}}\\\\p{{M}}\\'’]*(-[\\\\p{{L}}\\\\p{{M}}\\'’]+)*', 'X')"
    return f"regexp_extract_all({plain}, '{TOKEN}', 0)"


def _sql(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """The query with :name: for each view; braces are those of regular expressions."""
    query = query.replace("{", "{{").replace("}", "}}")
    for name in views:
        query = query.replace(f":{name}:", "{" + name + "}")
    return spark.sql(query, **views)


_PAIR = "xxhash64(if(t[i - 1] = '\\n', '\\n', t[i - 2]), t[i - 1])"
LONGER = 2  # times that the longer word must be more frequent


def weighed(docs: DataFrame) -> DataFrame:
    """(text, n): each text with the number of rows that hold its page.

    Rows hold one page if the longest line and all behind it are equal, up to what is put behind a cut; the menu above may differ. Only hashes
    are shuffled, summed on the map side first, unless more than BROADCAST_ROWS pages have copies.
    """
    spark = docs.sparkSession
    pages = _sql(
        spark,
        f"""
with a as (select text, regexp_replace(text, '[\\s\\p{{Z}}]+$', '') as x from :docs:),
b as (select text, x, substring_index(x, '\n', -1) as line from a),
c as (select text, concat(left(x, length(x) - length(line)), rtrim(regexp_replace(line, '{MARKS}', ''))) as x from b),
d as (select text, x, array_max(transform(split(x, '\n'), l -> struct(length(l) as n, l as l))).l as l from c)
select text, xxhash64(substring(x, instr(x, l))) as g from d""",
        docs=docs,
    )
    copies = materialize(pages.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    if copies.count() <= BROADCAST_ROWS:
        return pages.join(F.broadcast(copies), "g", "left").select("text", F.coalesce("n", F.lit(1)).alias("n"))
    heavy, light = copies.where(f"n > {HEAVY}").withColumnRenamed("n", "m"), copies.where(f"n <= {HEAVY}")
    # rows of heavy pages are settled by the first join and spread by a key of their own in the second
    rest = pages.join(F.broadcast(heavy), "g", "left").select("text", "m", F.when(F.col("m").isNull(), F.col("g")).otherwise(F.xxhash64(F.monotonically_increasing_id())).alias("g"))
    return rest.join(light, "g", "left").select("text", F.coalesce("m", "n", F.lit(1)).alias("n"))


def trigram_ends(docs: DataFrame) -> DataFrame:
    """For each trigram of the texts, as (hash of two words, third word, hash of all): seen, at_end (of a line or text), at_long_end (of one of LONG words and marks), near_end (one word follows).

    A text counts as 1 / n. Sums are rounded, so that they don't depend on the order of rows.
    """
    return _sql(
        docs.sparkSession,
        f"""
with w as (select 1D / n as c, concat(array('\\n', '\\n'), {_tokens("text")}, array('\\n', '\\n')) as t from :docs:),
e as (select c, explode(transform(sequence(2, size(t) - 3), i -> if(t[i] = '\\n', null, struct({_PAIR} as p, t[i] as w,
      if(t[i + 1] = '\\n', if(i > {LONG} and not array_contains(slice(t, i - {LONG} + 2, {LONG}), '\\n'), 3, 2), if(t[i + 2] = '\\n', 1, 0)) as e)))) as x from w where size(t) > 4),
g as (select x.p as p, x.w as w, round(sum(c), 6) as seen, round(sum(if(x.e >= 2, c, 0D)), 6) as at_end, round(sum(if(x.e = 3, c, 0D)), 6) as at_long_end, round(sum(if(x.e = 1, c, 0D)), 6) as near_end from e where x is not null group by x.p, x.w)
select p, w, xxhash64(p, w) as h, seen, at_end, at_long_end, near_end from g""",
        docs=docs,
    )


def find_cut(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key): texts that stop inside a word or sentence, whether or not something was put behind the cut.

    Null, empty and blank texts are none; repeated rows give repeated rows; an empty table gives an empty one. The trigrams of all texts are
    counted, long texts whole, copies of a page once. What is shuffled are counts of trigrams, summed on the map side first, hashes of pages, and
    the last words of those texts that do not end with a sentence.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("text")).where("text is not null and text rlike '[^\\\\s\\\\p{Z}]'")
    at = lambda n: _PAIR.replace("[i", f"[size(t) - {n}")
    last = _sql(
        spark,
        f"""
with r as (select k, substring_index(regexp_replace(text, '[\\\\s\\\\p{{Z}}]+$', ''), '\\n', -1) as raw from :docs:),
a as (select k, raw rlike '{MARKS}' as marked, regexp_extract(regexp_replace(raw, '{MARKS}', ''), '^[\\\\s\\\\p{{Z}}]*(.*?)[\\\\s\\\\p{{Z}}]*$', 1) as line from r),
b as (select k, marked, line from a where line <> '' and not line rlike '{SENTENCE_END}' and not line rlike '{LIST_ENTRY}' and not line rlike '{LABEL}'),
c as (select k, marked, concat(array('\\n', '\\n', '\\n'), {_tokens("line")}) as t from b)
select k, {at(1)} as p0, t[size(t) - 1] as w0, xxhash64({at(1)}, t[size(t) - 1]) as h0, xxhash64({at(2)}, t[size(t) - 2]) as h1,
       t[size(t) - 1] rlike '^[\\\\p{{Ll}}\\\\p{{Lo}}]' as small, marked, size(t) >= 3 + {LONG} as long from c where size(t) > 3""",
        docs=docs,
    )
    last = materialize(last, "last")
    ends = materialize(trigram_ends(weighed(docs)), "ends")
    asked = _sql(spark, "select distinct h from (select explode(array(h0, h1)) as h from :last:)", last=last)
    # how often a longer word follows the same two words: each frequent trigram once for each beginning of its word, so that the join is one of
    # equals and no pair of words has a task of its own
    longer = _sql(
        spark,
        f"""with q as (select distinct p0 as p, w0 as w, h0 as h from :last: where small),
        e as (select p, seen, explode(transform(sequence(1, length(w) - 1), n -> left(w, n))) as w from :ends: where length(w) > 1 and seen >= {SUPPORT} and at_end <= {AT_END} * seen)
        select h, max(seen) as longer from e join q using (p, w) group by h""",
        last=last, ends=ends,
    )
    # what is known of each last trigram, without the one page that asks
    known = _sql(
        spark,
        f"""select h, seen - 1 >= {SUPPORT} as known, at_end - 1 <= {AT_END} * (seen - 1) as inner_only, at_long_end - 1 <= {AT_END} * (seen - 1) as no_long_end,
        near_end + at_end - 1 <= {AT_END} * (seen - 1) as far_only, coalesce(longer, 0) >= {LONGER} * seen as part
        from :ends: left semi join :asked: using (h) left join :longer: using (h)""",
        ends=ends, asked=asked, longer=longer,
    )
    known = materialize(known, "known")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    a, b = known.alias("a"), known.alias("b")
    res = last.join(a, F.col("h0") == F.col("a.h"), "left").join(b, F.col("h1") == F.col("b.h"), "left")
    # the final trigram decides if it is known, else the one before it, else what the text shows
    return res.where("case when a.part then true when a.known then if(long, a.no_long_end, a.inner_only) when b.known then b.far_only else long or marked end").select(F.col("k").alias(key))


def cut_by_source(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Rows (source, pages, cut, share): how many of each source's texts are cut. Null sources are one of their own.

    Pages are rows whose text is not blank. Keys must tell rows apart.
    """
    cut = find_cut(df, key, text).select(F.col(key).alias("_k"), F.lit(1).alias("_c"))
    pages = df.select(F.col(key).alias("_k"), F.col(source).alias(source), F.col(text).rlike(r"[^\s\p{Z}]").alias("_t")).where("_t")
    return pages.join(cut, "_k", "left").groupBy(source).agg(F.count(F.lit(1)).alias("pages"), F.count("_c").alias("cut"), (F.count("_c") / F.count(F.lit(1))).alias("share"))
