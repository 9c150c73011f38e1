"""Queries on words and places in texts, and on flights in the queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import extract, find, tables, vocabulary
from ..sources.schema import document
from ..streaming import watchdog
from .catalog import _DOCUMENT, _NORM, query, status_events
from .shared import shared_dir

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""select id, 'the' as term, (list_sum(list_transform(p[1:k], lambda x: length(x))) + 3 * (k - 1))::int as start, (list_sum(list_transform(p[1:k], lambda x: length(x))) + 3 * k)::int as "end"
from (select id, p, unnest(range(1, len(p))) as k from (select id, string_split({_LOW.format('text')}, 'the') as p from document))"""
)
def find_places(spark, sf_dir):
    """Every place of a term in every text."""
    return find.places(document(spark, sf_dir), "id", "text", [" The "])


@query(
    f"""select id, (coalesce(len(string_split({_LOW.format('text')}, 'the')), 1) - 1)::int as matches,
    md5(regexp_replace(text, '[tT][hH][eE]', '{find.MARK[0]}\\0{find.MARK[1]}', 'g')) as marked_md5 from document"""
)
def find_marks(spark, sf_dir):
    """Every text with a term marked."""
    return find.marks(document(spark, sf_dir), "id", "text", ["the"]).select("id", "matches", F.md5("marked").alias("marked_md5"))


_MANY = ("the", "and", "ment", "a", "sie", "les", "de l", "xq", "ing ", "tion")


@query(
    "select id, term, count(*)::bigint as places, sum(start)::bigint as starts from (\n"
    + "\nunion all\n".join(
        f"""select id, '{t.strip()}' as term, list_sum(list_transform(p[1:k], lambda x: length(x))) + {len(t.strip())} * (k - 1) as start
    from (select id, p, unnest(range(1, len(p))) as k from (select id, string_split({_LOW.format('text')}, '{t.strip()}') as p from document))"""
        for t in _MANY
    )
    + ") group by id, term"
)
def find_many(spark, sf_dir):
    """Ten terms in one pass, some within others."""
    return find.places(document(spark, sf_dir), "id", "text", list(_MANY)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("places"), F.sum(F.col("start").cast("long")).alias("starts"))


def _index(spark, sf_dir):
    docs = document(spark, sf_dir).select("id", "text")
    return docs, vocabulary.build(docs, "id", "text", f"{shared_dir(spark)}/vocabulary-{uuid.uuid4().hex}")


@query(
    f"""select word, length(word)::int as length, count(*)::bigint as documents, md5(string_agg(id::varchar, ',' order by id)) as ids_md5
from (select id, unnest(list_distinct(list_append(list_filter(string_split({_NORM.format('text')}, ' '), lambda w: w <> ''), ''))) as word from document where text <> '') group by word"""
)
def vocabulary_index(spark, sf_dir):
    """The stored vocabulary of all texts: each word's documents."""
    index = _index(spark, sf_dir)[1]
    whole = F.sort_array(F.flatten(F.collect_list("ids")))
    joined = F.array_join(F.transform(whole, lambda i: i.cast("string")), ",")
    return index.groupBy("word", "length").agg(F.size(whole).cast("long").alias("documents"), F.md5(joined).alias("ids_md5"))


@query()
def vocabulary_search(spark, sf_dir):
    """Nine terms in one pass over the vocabulary. No SQL: the ratio is defined by its matching blocks; tested against the definition."""
    docs, index = _index(spark, sf_dir)
    return vocabulary.search(index, ["pathetc", "Theory!", "understnad", "et", "verfahren", "les", "zzzzzz", "of teh", "!!"], docs)


_LIMIT = 2 * 86400


@query(
    f"""select id, event_id, ts, status from (
    select id, event_id, ts, 'pending' as status from walk where admitted
    union all select id, null, was + interval {_LIMIT} second, 'fail' from walk where late
    union all select id, null, start + interval {_LIMIT} second, 'fail' from walk w where start + interval {_LIMIT} second <= (select max(ts) from ev) and rn = (select max(rn) from ev where ev.id = w.id)
)""",
    tables=f"""with recursive ev as (
    select user_id as id, ts, event_id, case event_type when 'signup' then 'pending' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'done' when 'error' then 'fail' end as status,
        row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type in ('signup', 'view', 'click', 'purchase', 'error')
), walk as (
    select distinct id, 0::bigint as rn, null::timestamp as start, null::timestamp as was, null::bigint as event_id, null::timestamp as ts, false as late, false as admitted from ev
    union all
    select ev.id, ev.rn,
        case when status in ('done', 'fail') then null when status = 'pending' and (w.start is null or ev.ts > w.start + interval {_LIMIT} second) then ev.ts when ev.ts > w.start + interval {_LIMIT} second then null else w.start end,
        w.start, ev.event_id, ev.ts, coalesce(ev.ts > w.start + interval {_LIMIT} second, false), status = 'pending' and (w.start is null or ev.ts > w.start + interval {_LIMIT} second)
    from walk w join ev on ev.id = w.id and ev.rn = w.rn + 1
)""",
)
def guarded_flights(spark, sf_dir):
    """Admissions, and failures of flights of over two days."""
    return watchdog.guarded(status_events(spark, sf_dir), _LIMIT).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _lines(content: bytes):
    yield from content.split(b"\n")


@query("select doc_id, (k + 1)::int as page, md5(line) as image_md5 from (select id as doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as k from document)")
def pages_by_lateral_join(spark, sf_dir):
    """Lines of texts as the pages of files, by a table function."""
    files = document(spark, sf_dir).select(F.col("id").alias("doc_id"), F.encode("text", "UTF-8").alias("content"))
    return tables.pages_of(files, _lines).select("doc_id", "page", F.md5("image").alias("image_md5"))


def _plain(content: bytes) -> str:
    return content.decode() if content[-1:] != b"." else ""


@query(
    """select id, md5(case when text like '%.' then '[BŁĄD ODCZYTU] Nie można odczytać dokumentu Word. ' else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end) as text_md5,
    case when text like '%.' then null else 'plain' end as parser, case when text like '%.' then 'docx: BadZipFile,plain: empty' else 'docx: BadZipFile' end as tried from document where text <> ''"""
)
def texts_by_parser_chain(spark, sf_dir):
    """Texts that are no Word files go on to the next parser, which takes those that do not end in a full stop."""
    files = document(spark, sf_dir).where("text <> ''").select("id", F.encode("text", "UTF-8").alias("content"))
    return extract.word_texts(files, [("plain", _plain)]).select("id", F.md5("text").alias("text_md5"), "parser", F.array_join("tried", ",").alias("tried"))


@query("select id, case when id % 5 = 0 then 'k4' else step end as step, case when id % 5 = 0 then 2::bigint else 0::bigint end as version from document where id % 10 <> 3 union all select id + 1000000000, 'k1', 1::bigint from document where id % 20 = 7")
def table_after_changes(spark, sf_dir):
    """The stored table after two batches of changes, one of them repeated and late: new states, new rows and removals."""
    path = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    docs = document(spark, sf_dir).select("id", "step")
    state = lambda where, id_, version, step, deleted: docs.where(where).selectExpr(f"{id_} as id", f"{version}L as version", f"{step} as step", f"{deleted} as deleted")
    tables.keep(state("true", "id", 0, "step", "false"), path)
    first = state("id % 5 = 0", "id", 1, "'k2'", "false").unionByName(state("id % 20 = 7", "id + 1000000000", 1, "'k1'", "false"))
    second = state("id % 5 = 0", "id", 2, "'k4'", "false").unionByName(state("id % 10 = 3", "id", 2, "null", "true"))
    put = tables.upsert(path)
    for n, batch in enumerate((first, second, first)):
        put(batch, n)
    return tables.table(spark, path).select("id", "step", "version")
