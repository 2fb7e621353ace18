"""How the sources of a language differ in their words (operator 13): counts and pair sums by DuckDB in shards, merged by Spark.

Each task counts the terms of its documents in SQL and sends one row for a
language, source and term. Rows are dealt to shards by the hash of language and
term, so that a shard holds a term's counts in all sources: SQL drops the rare
terms there, and later, when the totals are known, sums the differences of each
pair of sources over its terms and ranks its own terms. Spark adds the shards'
sums and merges their rankings.
"""

from __future__ import annotations

import re
import shutil
import string
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offermill.llm.base import table, written

#: Documents of a language that a term must be in; what is added to each count; ranks of terms that are returned.
LEAST, ADDED, TOP = 30, 5, 50
#: A term's characters are all but these (in a class of a regular expression).
OTHERS = r"\x00-\x40\x5B-\x60\x7B-\x7F"
#: Bytes of text that one SQL statement counts; a longer text is cut between terms.
BLOCK_BYTES = 8 << 20
#: Rows that a task counts before it sends them, counts of kept terms in a shard, about, and DuckDB's memory in a task.
SENT_ROWS, SHARD_ROWS, MEMORY = 1_000_000, 200_000, "300MB"

_between = re.compile(f"[{OTHERS}]")
#: A share of 1 + 1000000000 (n + ADDED) / (total + ADDED terms), rounded down: integers of 128 bits, so exact.
_SHARE = "cast(1 + 1000000000::hugeint * ({n} + {added}) // ({total} + {added} * terms) as bigint)"


@contextmanager
def _duckdb() -> Iterator[duckdb.DuckDBPyConnection]:
    """A database of one task; what exceeds its memory goes to a folder that ends with it."""
    spill = tempfile.mkdtemp(prefix="offermill-duckdb-")
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(spill, ignore_errors=True)


def _run(con: duckdb.DuckDBPyConnection, sql: str, **tables: pa.Table) -> None:
    for name, rows in tables.items():
        con.register(name, rows)
    con.execute(sql).complete()
    for name in tables:
        con.unregister(name)


def _pieces(docs: pa.Table) -> Iterator[list[pa.Table]]:
    """The documents in blocks of about BLOCK_BYTES; a document beyond that is a block of its pieces."""
    size = pc.fill_null(pc.binary_length(docs["text"]), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate([*size, BLOCK_BYTES + 1]):
        if held + n > BLOCK_BYTES and i > begin:
            yield [docs.slice(begin, i - begin)]
            begin, held = i, 0
        if i < len(size) and n > BLOCK_BYTES:
            text, row, cuts = docs["text"][i].as_py(), docs.slice(i, 1).drop_columns("text"), [0]
            while (found := _between.search(text, cuts[-1] + BLOCK_BYTES // 4)) is not None:
                cuts.append(found.end())
            yield [row.append_column("text", pa.array([text[a:b]], pa.string())) for a, b in zip(cuts, [*cuts[1:], len(text)])]
            begin, held = i + 1, 0
        else:
            held += n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs (the documents with the term) of the task's documents."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    with _duckdb() as con:
        _run(con, "create table counts (lang varchar, source varchar, term varchar, n bigint, docs bigint)")
        _run(con, "create table block (i bigint, lang varchar, source varchar, term varchar, n bigint)")
        rows = 0
        for batch in batches:
            docs = pa.Table.from_batches([batch])
            docs = docs.append_column("i", pa.array(range(len(docs)), pa.int64()))
            for pieces in _pieces(docs):
                for piece in pieces:
                    terms = f"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^{OTHERS}]+'))"
                    _run(con, f"insert into block select i, lang, source, term, count(*) from (select i, lang, source, {terms} as term from piece) group by all", piece=piece)
                _run(con, "insert into counts select lang, source, term, sum(n), count(distinct i) from block group by all")
                _run(con, "truncate block")
            rows = con.execute("select count(*) from counts").fetchall()[0][0]
            if rows > SENT_ROWS:
                yield from con.sql("select lang, source, term, cast(sum(n) as bigint) as n, cast(sum(docs) as bigint) as docs from counts group by all").to_arrow_reader(50_000)
                _run(con, "truncate counts")
        yield from con.sql("select lang, source, term, cast(sum(n) as bigint) as n, cast(sum(docs) as bigint) as docs from counts group by all").to_arrow_reader(50_000)


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of the shard's terms that enough documents of a language have; `first` marks one row a term."""
        with _duckdb() as con:
            _run(con, "create table counts (lang varchar, source varchar, term varchar, n bigint, docs bigint)")
            for batch in batches:
                _run(con, "insert into counts select lang, source, term, n, docs from rows", rows=pa.Table.from_batches([batch]))
            yield from con.sql(f"""
                with kept as (select lang, term, min(source) as least from counts group by all having sum(docs) >= {least})
                select lang, source, term, cast(sum(n) as bigint) as n, cast(source = any_value(kept.least) as integer) as first
                from counts join kept using (lang, term) group by lang, source, term""").to_arrow_reader(50_000)

    return run


def _compared(added: int, top: int):
    share = lambda n, total: _SHARE.format(n=n, total=total, added=added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part, lang, source, item and value: sums over the shard's terms for pairs of sources, and its foremost terms.

        For sources a and b only terms that one of them has are looked at: what
        a term adds is first taken as if the other source, or both, had none
        of it, which needs no more than a histogram, and put right where both have it.
        """
        with _duckdb() as con:
            _run(con, "create table counts (lang varchar, source varchar, term varchar, n bigint)")
            _run(con, "create table groups (lang varchar, source varchar, total bigint, lang_total bigint, terms bigint)")
            for batch in batches:
                _run(con, "insert into counts select lang, source, term, n from rows where term is not null; insert into groups select lang, source, total, lang_total, terms from rows where term is null", rows=pa.Table.from_batches([batch]))
            _run(con, f"""
                create table g as select lang, source, total, lang_total, terms, case when terms > 0 then {share("0", "total")} else 0 end as p0
                from (select distinct * from groups)""")
            _run(con, f"create table p as select lang, source, term, {share('n', 'total')} as p from counts join g using (lang, source)")
            _run(con, f"""
                create table q as select lang, term, {share("s", "lang_total")} as q
                from (select lang, term, sum(n) as s from counts group by all) join (select distinct lang, lang_total, terms from g) using (lang)""")
            yield from con.sql("""
                with here as (select lang, count(*) as v from q group by all),
                has as (select lang, source, count(*) as k from p group by all),
                alone as (  -- the terms of a, as if b had none of them
                    select h.lang, h.source as a, b.source as b, sum(h.m * abs(h.p - b.p0)) as s
                    from (select lang, source, p, count(*) as m from p group by all) h join g b on b.lang = h.lang and b.source <> h.source group by all),
                shared as (
                    select x.lang, x.source as a, y.source as b, sum(abs(x.p - y.p) - abs(x.p - gb.p0) - abs(y.p - ga.p0) + abs(ga.p0 - gb.p0)) as s
                    from p x join p y on x.lang = y.lang and x.term = y.term and x.source < y.source
                    join g ga on ga.lang = x.lang and ga.source = x.source join g gb on gb.lang = y.lang and gb.source = y.source group by all)
                select 'pair' as part, ga.lang as lang, ga.source as source, gb.source as item,
                    cast((coalesce(v, 0) - coalesce(ha.k, 0) - coalesce(hb.k, 0)) * abs(ga.p0 - gb.p0) + coalesce(ab.s, 0) + coalesce(ba.s, 0) + coalesce(shared.s, 0) as bigint) as value
                from g ga join g gb on ga.lang = gb.lang and ga.source < gb.source left join here on here.lang = ga.lang
                left join has ha on ha.lang = ga.lang and ha.source = ga.source left join has hb on hb.lang = gb.lang and hb.source = gb.source
                left join alone ab on ab.lang = ga.lang and ab.a = ga.source and ab.b = gb.source
                left join alone ba on ba.lang = ga.lang and ba.a = gb.source and ba.b = ga.source
                left join shared on shared.lang = ga.lang and shared.a = ga.source and shared.b = gb.source""").to_arrow_reader(50_000)
            yield from con.sql(f"""
                select 'term' as part, lang, source, term as item, cast(p - q as bigint) as value from p join q using (lang, term) where p > q
                qualify row_number() over (partition by lang, source order by p - q desc, term) <= {top}""").to_arrow_reader(50_000)

    return run


def _named(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, added: int = ADDED, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: for each source of a language the others by distance, and the terms it uses more.

    A term is a stretch of letters A-Z (lower-cased) and characters beyond
    U+007F; a language keeps those in at least `least` of its documents. With n
    the occurrences of a kept term in a source, N their sum there and V the
    kept terms of the language, its share is p = 1 + floor(10^9 (n + added) /
    (N + added V)). Part `pair` has the sums of |p - q| over all kept terms
    for each other source, part `term` the `top` greatest differences from
    the whole language's share, of terms that the source has and uses more.
    Ranks go by falling value, then by item in the order of its bytes.

    Null and empty texts have no terms, null languages and sources count as
    ''; each row is a document, whatever its id. A source without terms is
    compared all the same; a language without kept terms has distances of 0,
    one of a single source no pairs. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")).select(*map(_named, ("text", "lang", "source")))
    counts = mine.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    kept = written(counts.repartition("lang", "term").mapInArrow(_frequent(least), "lang string, source string, term string, n long, first int"), "terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    sources = mine.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["n", "first"])
    langs = sources.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
    groups = sources.join(langs, "lang").select("lang", "source", F.col("n").alias("total"), "lang_total", "terms")

    # each shard gets the groups beside the counts of its terms: by the same shuffle, not as a broadcast
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // SHARD_ROWS))
    dealt = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard"), "lang", "source", "term", "n", *(F.lit(None).cast("long").alias(c) for c in ("total", "lang_total", "terms")))
    around = groups.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "total", "lang_total", "terms")
    parts = dealt.unionByName(around).repartition(shards, "shard").mapInArrow(_compared(added, top), "part string, lang string, source string, item string, value long")

    parts = written(parts, "parts")
    once = parts.where("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    both = once.unionByName(once.select("part", "lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = both.withColumn("rank", place).unionByName(parts.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = f"""
with docs as (select row_number() over () as i, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
words as (select i, lang, source, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^{OTHERS}]+')) as term from docs),
kept as (select lang, term from words group by all having count(distinct i) >= {LEAST}),
counted as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
groups as (select distinct lang, source from docs),
v as (select lang, count(*) as v from kept group by all),
dense as (
    select groups.lang, groups.source, kept.term, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by groups.lang, groups.source) as total, v
    from groups join kept on kept.lang = groups.lang join v on v.lang = groups.lang left join counted on counted.lang = groups.lang and counted.source = groups.source and counted.term = kept.term),
shares as (select lang, source, term, n, 1 + 1000000000::hugeint * (n + {ADDED}) // (total + {ADDED} * v) as p from dense),
whole as (select lang, term, 1 + 1000000000::hugeint * (n + {ADDED}) // (sum(n) over (partition by lang) + {ADDED} * v) as q from (select lang, term, sum(n) as n, any_value(v) as v from dense group by all)),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join (select x.lang, x.source as a, y.source as b, sum(abs(x.p - y.p)) as value from shares x join shares y using (lang, term) where x.source <> y.source group by all) d on d.lang = a.lang and d.a = a.source and d.b = b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from shares join whole using (lang, term) where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
where part = 'pair' or rank <= {TOP}
"""
