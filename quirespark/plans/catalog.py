"""The core queries, each a function of (spark, sf_dir), and their DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import contents, listing, mutate, ocr, rollup, versions
from ..sources import files, sinks
from ..sources.schema import DUCKDB_ROWS, document
from ..streaming import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_DOCUMENT = f"with document as (select {DUCKDB_ROWS} from documents)"
#: DuckDB's form of functions.text.normalize().
_NORM = "trim(regexp_replace(regexp_replace(translate(lower(coalesce({0}, '')), 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'acelnoszzACELNOSZZ'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_META = "lower(concat_ws(' ', nullif(original_filename, ''), nullif(sygnatura, ''), nullif(doc_type, '')))"
_LABEL = """case when is_main then 'Opinia główna' when mime_type like 'image/%' then 'Obraz' when mime_type = 'application/pdf' then 'PDF'
    when mime_type like '%word%' then 'Word' when doc_type = 'OCR TXT' then 'Wynik OCR' else 'Dokument' end"""
_MINUTE = "coalesce(strftime({0}, '%Y-%m-%d %H:%M'), '')"
NOW = "2024-06-01 12:00:00"


def query(sql: str | None = None, tables: str = _DOCUMENT) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"{tables}\n{sql}" if tables else sql
        return f

    return add


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.status_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


# Listings


@query(
    f"""select id, sygnatura, doc_type, step, {_LABEL} as kind,
    case ocr_status when 'done' then 'Zakończony' when 'running' then 'W trakcie' when 'fail' then 'Błąd' when 'pending' then 'Oczekuje' else 'Brak' end as ocr,
    {_MINUTE.format('upload_time')} as added, row_number() over (order by upload_time desc, id desc) as position
from document where step in ('k1', 'k3') and doc_type = 'Inne' and contains({_META}, 'plik_1')"""
)
def doc_list_by_step(spark, sf_dir):
    """Documents of two steps and a kind that hold a term in their metadata, newest first."""
    found = listing.search(listing.by_type(listing.by_steps(document(spark, sf_dir), ["k1", "k3"]), "Inne"), "Plik_1")
    c = F.col
    kind, ocr_state = L.kind_label(c("is_main"), c("mime_type"), c("doc_type")).alias("kind"), L.ocr_label(c("ocr_status")).alias("ocr")
    shown = found.select("id", "sygnatura", "doc_type", "step", kind, ocr_state, L.minute(c("upload_time")).alias("added"), "upload_time")
    return listing.numbered(shown).drop("upload_time")


@query("select id, step from document where is_main and step in ('k1', 'k2', 'k3')")
def doc_list_default_opinions(spark, sf_dir):
    return listing.cases(document(spark, sf_dir)).select("id", "step")


@query("select id, step from document where false")
def doc_list_empty_filter(spark, sf_dir):
    return listing.cases(document(spark, sf_dir), search="a").select("id", "step")


@query("select id, step from document")
def doc_list_all_steps(spark, sf_dir):
    return listing.by_steps(document(spark, sf_dir), []).select("id", "step")


@query(f"select id, array_to_string(['metadata'], ',') as matches from document where contains({_META}, '.docx src1')")
def doc_search_metadata(spark, sf_dir):
    """A term that spans two fields."""
    return listing.search(document(spark, sf_dir), ".DOCX src1").select("id", F.array_join("matches", ",").alias("matches"))


@query(
    f"""select id, matches from (
    select id, concat_ws(',', case when contains({_META}, 'the') then 'metadata' end, case when contains(lower(text), 'the') then 'content' end) as matches from document
) where matches <> ''"""
)
def doc_search_content(spark, sf_dir):
    return listing.search(document(spark, sf_dir), "The", content=True).select("id", F.array_join("matches", ",").alias("matches"))


@query(f"select id from document where contains({_NORM.format('text')}, 'the and')")
def doc_search_normalized(spark, sf_dir):
    return document(spark, sf_dir).where(F.contains(X.normalize(F.col("text")), F.lit(X.normalized("The, and!")))).select("id")


@query()
def doc_search_fuzzy(spark, sf_dir):
    """No SQL: the ratio is defined by its matching blocks; tested against the definition."""
    return listing.search(document(spark, sf_dir), "pathetc", content=True, fuzzy=True).select("id", F.array_join("matches", ",").alias("matches"))


@query("select distinct doc_type from document where nullif(doc_type, '') is not null")
def doc_type_facets(spark, sf_dir):
    return listing.facets(document(spark, sf_dir))


@query(
    f"""select id, {_LABEL} as kind, coalesce(sygnatura, '') as person, coalesce(doc_type, '') as doc_type, original_filename, step,
    case ocr_status when 'done' then 'Zakończony' when 'running' then 'W trakcie' when 'fail' then 'Błąd' when 'pending' then 'Oczekuje' else 'Brak' end as ocr,
    {_MINUTE.format('upload_time')} as added, {_MINUTE.format('last_modified')} as modified from document"""
)
def doc_export_projection(spark, sf_dir):
    return listing.export(document(spark, sf_dir)).toDF("id", "kind", "person", "doc_type", "original_filename", "step", "ocr", "added", "modified")


@query("select count(*) as documents, count(*) filter (is_main) as cases, count(*) filter (ocr_status = 'done') as ocr_done, count(*) filter (mime_type = 'application/pdf') as pdfs, count(*) filter (mime_type = 'image/') as images from document")
def list_counters(spark, sf_dir):
    return rollup.list_counters(document(spark, sf_dir))


@query("select id, ocr_status, step from document where id = 7")
def doc_by_id(spark, sf_dir):
    return listing.by_id(document(spark, sf_dir), 7).select("id", "ocr_status", "step")


# Parents and children


@query("select d.id, d.parent_id, p.sygnatura as parent_sygnatura, p.step as parent_step from document d left join document p on d.parent_id = p.id")
def child_parent_left_join(spark, sf_dir):
    return rollup.with_parent(document(spark, sf_dir)).select("id", "parent_id", "parent_sygnatura", "parent_step")


@query(
    """select r.id as case_id, count(c.id) as total, count(*) filter (c.ocr_status = 'pending') as pending, count(*) filter (c.ocr_status = 'running') as running,
    count(*) filter (c.ocr_status = 'done') as done, count(*) filter (c.ocr_status = 'fail') as failed,
    count(*) filter (c.ocr_status in ('pending', 'running')) > 0 as has_active_ocr
from document r left join document c on c.parent_id = r.id where r.is_main group by r.id"""
)
def case_status_counts(spark, sf_dir):
    return rollup.status_counts(document(spark, sf_dir))


@query(
    """select case_id, kind, documents, newest_id, row_number() over (partition by case_id order by newest desc, newest_id desc) as place from (
    select parent_id as case_id, coalesce(nullif(doc_type, ''), 'Inne') as kind, count(*) as documents, max(upload_time) as newest, arg_max(id, (upload_time, id)) as newest_id
    from document where parent_id is not null group by all)"""
)
def case_groups_by_type(spark, sf_dir):
    return rollup.groups_by_type(document(spark, sf_dir))


@query(
    """select r.id as case_id, count(c.id) as total, count(*) filter (c.ocr_status = 'pending') as pending, count(*) filter (c.ocr_status = 'running') as running, count(*) filter (c.ocr_status = 'done') as done,
    case when count(c.id) > 0 then count(*) filter (c.ocr_status = 'fail') end as failed,
    round(case when count(c.id) = 0 then 1e0 else avg(case when c.id is null then null when c.ocr_status = 'done' then 1e0 when c.ocr_status in ('pending', 'running') then coalesce(c.ocr_progress, 0e0) else 0e0 end) end, 6) as progress,
    count(c.id) = 0 or (count(*) filter (c.ocr_status in ('pending', 'running')) = 0 and count(*) filter (c.ocr_status = 'done') > 0) as ocr_done
from document r left join document c on c.parent_id = r.id and c.doc_type <> 'OCR TXT' where r.is_main group by r.id"""
)
def case_ocr_progress(spark, sf_dir):
    return rollup.ocr_progress(document(spark, sf_dir))


@query(
    """select r.id as case_id, count(c.id) as documents, count(*) filter (c.ocr_status = 'done') as ocr_done, count(*) filter (c.ocr_status = 'running') as ocr_running,
    count(*) filter (c.mime_type = 'application/pdf') as pdfs, count(*) filter (c.mime_type = 'image/') as images, max(c.upload_time) as last_upload, count(c.last_modified) > 0 as any_modified
from document r left join document c on c.parent_id = r.id where r.is_main group by r.id"""
)
def case_footer_counts(spark, sf_dir):
    return rollup.footer_counts(document(spark, sf_dir))


# Versions

_LATEST = "select * from document where ocr_parent_id is not null and doc_type = 'OCR TXT' qualify row_number() over (partition by ocr_parent_id order by upload_time desc, id desc) = 1"


@query(f"select ocr_parent_id as source_id, id, upload_time from ({_LATEST})")
def latest_ocr_per_source(spark, sf_dir):
    return versions.latest_ocr(document(spark, sf_dir)).select(F.col("ocr_parent_id").alias("source_id"), "id", "upload_time")


@query(f"select d.id, l.id as ocr_id from document d left join ({_LATEST}) l on l.ocr_parent_id = d.id and d.ocr_status = 'done'")
def detail_with_ocr(spark, sf_dir):
    return versions.with_latest_ocr(document(spark, sf_dir).drop("text"), only_done=True).select("id", "ocr_id")


@query("select id from document d where exists (select 1 from document o where o.ocr_parent_id = d.id and o.doc_type = 'OCR TXT')")
def has_ocr_semi(spark, sf_dir):
    return versions.has_ocr(document(spark, sf_dir)).select("id")


@query("select id from document d where not exists (select 1 from document o where o.ocr_parent_id = d.id and o.doc_type = 'OCR TXT')")
def without_ocr_anti(spark, sf_dir):
    return versions.without_ocr(document(spark, sf_dir)).select("id")


@query(
    """select parent_id, id, cast(row_number() over (partition by parent_id order by upload_time desc, id desc) as int) as version, count(*) over (partition by parent_id) as versions
from document where parent_id is not null and doc_type = 'Archiwalna wersja'"""
)
def version_history(spark, sf_dir):
    return versions.history(document(spark, sf_dir)).select("parent_id", "id", "version", "versions")


@query(
    """select family_id, id, cast(row_number() over (partition by family_id order by last_modified desc nulls last, id desc) as int) as place from (
    select *, case when is_main then id else parent_id end as family_id from document) where family_id is not null"""
)
def version_family(spark, sf_dir):
    return versions.family(document(spark, sf_dir)).select("family_id", "id", "place")


@query(
    """select family_id, id from (select *, case when is_main then id else parent_id end as family_id from document) where id % 3 <> 0
qualify row_number() over (partition by family_id order by last_modified desc nulls last, id desc) = 1"""
)
def first_available_file(spark, sf_dir):
    """The files of two documents in three are there."""
    docs = document(spark, sf_dir).drop("text")
    there = docs.where("id % 3 <> 0").select(F.concat(F.lit("file:/files/"), "stored_filename").alias("path"))
    return versions.available(docs, there).select("family_id", "id")


@query("select id from document where (stored_filename like '%.empty' and is_main) or mime_type like '%word%'")
def updatable_documents(spark, sf_dir):
    return versions.updatable(document(spark, sf_dir)).select("id")


# Texts


_SPACED = "(select id, case when id % 20 = 0 then replace(text, ' ', chr(160)) else text end as text from document)"
_WORDS = f"len(list_filter(regexp_split_to_array(text, '{X.WHITE}+'), lambda w: w <> ''))"
_PARAGRAPHS = f"len(list_filter(regexp_split_to_array(text, '\\n{X.WHITE}*\\n'), lambda p: regexp_replace(p, '{X.WHITE}+', '', 'g') <> ''))"
_SOLID = f"length(regexp_replace(text, '{X.WHITE}', '', 'g'))"


@query(
    f"""select id, length(text) as characters, {_WORDS} as words, {_PARAGRAPHS} as paragraphs, len(string_split(text, chr(10))) as lines, {_SOLID} as solid_characters,
    round({_SOLID} / nullif({_WORDS}, 0), 6) as mean_word_length, round({_WORDS} / nullif({_PARAGRAPHS}, 0), 6) as words_per_paragraph, strlen(text) as bytes from {_SPACED}"""
)
def text_stats(spark, sf_dir):
    """One text in twenty has no-break spaces for spaces."""
    text = F.when(F.col("id") % 20 == 0, F.replace("text", F.lit(" "), F.lit("\u00a0"))).otherwise(F.col("text"))
    d = document(spark, sf_dir).select("id", text.alias("text"))
    return d.select("id", *(c.alias(n) for n, c in X.stats(F.col("text")).items()))


@query("select id, cast((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 as bigint) as occurrences from document")
def term_occurrences(spark, sf_dir):
    return document(spark, sf_dir).select("id", X.occurrences(F.col("text"), "The").cast("long").alias("occurrences"))


@query(
    r"""select id, round(case when length(text) < 10 then 0e0 else greatest(0e0, least(1e0, 0.9e0 - least(0.3e0, (length(text) - length(translate(text, '?�', ''))) / length(text) * 5e0)
    - case when m < 2 or m > 15 then 0.1e0 else 0e0 end - case when length(text) < 100 then 0.2e0 else 0e0 end)) end, 6) as confidence
from (select id, text, length(regexp_replace(text, '\s', '', 'g')) / nullif(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')), 0) as m from document)"""
)
def ocr_confidence(spark, sf_dir):
    return document(spark, sf_dir).select("id", F.round(X.confidence(F.col("text")), 6).alias("confidence"))


@query()
def clean_ocr_text(spark, sf_dir):
    """No SQL: lines are folded in order; tested on golden texts."""
    return document(spark, sf_dir).select("id", X.clean_ocr_text("text").alias("clean"))


@query(f"select id, {_NORM.format('text')} as normal from document")
def normalized_text(spark, sf_dir):
    return document(spark, sf_dir).select("id", X.normalize(F.col("text")).alias("normal"))


@query(
    f"""select id, case when p > 0 then (case when greatest(0, o - 100) > 0 then '...' else '' end) || substr(text, greatest(0, o - 100) + 1, least(length(text), o + 100) - greatest(0, o - 100)) || (case when least(length(text), o + 100) < length(text) then '...' else '' end)
    when length(text) > 200 then substr(text, 1, 200) || '...' else text end as snippet
from (select id, text, p, cast(floor((p - 1) * length(text) / nullif(length(n), 0)) as int) as o from (select id, text, n, instr(n, 'this') as p from (select id, text, {_NORM.format('text')} as n from document)))"""
)
def search_snippet(spark, sf_dir):
    return document(spark, sf_dir).select("id", X.snippet(F.col("text"), "This").alias("snippet"))


_OWN = "case when d.mime_type = 'application/pdf' or d.mime_type like '%word%' or d.mime_type = 'text/plain' or d.doc_type = 'OCR TXT' then d.text else '' end"


@query(
    rf"""select d.id, md5(case when (d.mime_type like 'image/%' or d.mime_type = 'application/pdf') and regexp_matches(l.text, '\S')
    then regexp_replace({_OWN} || chr(10) || chr(10) || '=== OCR RESULTS ===' || chr(10) || l.text, '^\s+|\s+$', '', 'g') else {_OWN} end) as content_md5
from document d left join ({_LATEST}) l on l.ocr_parent_id = d.id"""
)
def document_content(spark, sf_dir):
    return contents.with_ocr(document(spark, sf_dir)).select("id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("select id, case when length(text) > 500 then substr(text, 1, 500) || '...' || chr(10) || '[Skrócone - pobierz pełny tekst, aby zobaczyć więcej]' else text end as preview from document")
def text_preview(spark, sf_dir):
    return document(spark, sf_dir).select("id", contents.preview(F.col("text"), 500).alias("preview"))


@query("select id, md5('Streść dokument.' || chr(10) || chr(10) || case when length(text) > 8000 then substr(text, 1, 8000) || chr(10) || chr(10) || '[TEKST SKRÓCONY...]' else text end) as prompt_md5 from document")
def summary_prompt(spark, sf_dir):
    return document(spark, sf_dir).select("id", F.md5(L.prompt(F.col("text"), "Streść dokument.").cast("binary")).alias("prompt_md5"))


_PAGES = "pages_of as (select id as doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as page from document)"


@query(
    f""", {_PAGES}
select doc_id, md5(regexp_replace(string_agg('=== Strona ' || page || ' ===' || chr(10) || chr(10) || text, chr(10) || chr(10) order by page), '^\\s+|\\s+$', '', 'g')) as text_md5, count(*) as pages from pages_of group by doc_id"""
)
def page_assemble(spark, sf_dir):
    pages = ocr.text_pages(document(spark, sf_dir)).withColumn("confidence", F.lit(0.0))
    return ocr.assemble(pages).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "pages")


@query(
    f""", {_PAGES}
select doc_id, round(avg(case when length(text) < 10 then 0e0 else greatest(0e0, 0.9e0 - least(0.3e0, (length(text) - length(translate(text, '?�', ''))) / length(text) * 5e0)
    - case when m < 2 or m > 15 then 0.1e0 else 0e0 end - case when length(text) < 100 then 0.2e0 else 0e0 end) end), 6) as confidence
from (select *, length(regexp_replace(text, '\\s', '', 'g')) / nullif(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 0) as m from pages_of) group by doc_id"""
)
def page_confidence_mean(spark, sf_dir):
    pages = ocr.text_pages(document(spark, sf_dir)).withColumn("confidence", X.confidence(F.col("text")))
    return pages.groupBy("doc_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"))


@query()
def recognized_documents(spark, sf_dir):
    """Lines as pages through clean-up, score and assembly. No SQL: see clean_ocr_text."""
    return ocr.assemble(ocr.scored(ocr.text_pages(document(spark, sf_dir)))).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("confidence", 6).alias("confidence"), "pages")


# Derived columns


@query(
    """select id, greatest(0, x1 - 5) as "left", greatest(0, y1 - 5) as top, least(w, x2 + 5) as "right", least(h, y2 + 5) as bottom,
    round(case when least(least(w, x2 + 5) - greatest(0, x1 - 5), least(h, y2 + 5) - greatest(0, y1 - 5)) < 300 then 300e0 / least(least(w, x2 + 5) - greatest(0, x1 - 5), least(h, y2 + 5) - greatest(0, y1 - 5)) else 1e0 end, 6) as scale
from (select id, w, h, cast(floor(id % 7 / 10e0 * w) as int) as x1, cast(floor(id % 5 / 10e0 * h) as int) as y1, cast(floor((id % 7 / 10e0 + 0.25e0) * w) as int) as x2, cast(floor((id % 5 / 10e0 + 0.5e0) * h) as int) as y2
from (select id, cast(800 + id % 400 as int) as w, cast(600 + id % 300 as int) as h from document))"""
)
def crop_box(spark, sf_dir):
    d = document(spark, sf_dir).select("id", (F.lit(800) + F.col("id") % 400).cast("int").alias("w"), (F.lit(600) + F.col("id") % 300).cast("int").alias("h"))
    x, y = F.col("id") % 7 / 10, F.col("id") % 5 / 10
    box = L.crop_box(x, y, x + 0.25, y + 0.5, F.col("w"), F.col("h"))
    return d.select("id", *(F.round(c, 6).alias(n) if n == "scale" else c.alias(n) for n, c in box.items()))


@query(
    """select id, case when n = 0 then '0 B' when n < 1024 then printf('%.1f B', n / 1e0) when n < 1048576 then printf('%.1f KB', n / 1024e0) when n < 1073741824 then printf('%.1f MB', n / 1048576e0) when n < 1099511627776 then printf('%.1f GB', n / 1073741824e0) else printf('%.1f TB', n / 1099511627776e0) end as size
from (select id, case when id % 9 = 0 then 0 else strlen(text) * cast(power(37, id % 9) as bigint) end as n from document)"""
)
def file_size_label(spark, sf_dir):
    n = F.when(F.col("id") % 9 == 0, 0).otherwise(F.octet_length("text") * F.pow(F.lit(37), F.col("id") % 9).cast("long")).cast("long")
    return document(spark, sf_dir).select("id", L.file_size(n).alias("size"))


@query(
    rf"""select id, case when coalesce(regexp_replace(note, '\s+', '', 'g'), '') = '' then s else note || chr(10) || chr(10) || '---' || chr(10) || chr(10) || s end as note_after
from (select id, note, '[PODSUMOWANIE AI - {NOW[:16]}]' || chr(10) || step as s from document)"""
)
def note_merge(spark, sf_dir):
    return document(spark, sf_dir).select("id", L.note_with_summary(F.col("note"), F.col("step"), NOW[:16]).alias("note_after"))


@query("select id, case when mime_type like 'image/%' then 'image' when mime_type like '%word%' then 'opinion' else 'document' end as content from document")
def content_type_from_mime(spark, sf_dir):
    return document(spark, sf_dir).select("id", L.content_type(F.col("mime_type")).alias("content"))


@query("select id, coalesce(nullif(sygnatura, ''), nullif(original_filename, ''), 'Opinia #' || id) as name from document")
def display_name(spark, sf_dir):
    return document(spark, sf_dir).select("id", L.display_name(F.col("sygnatura"), F.col("original_filename"), F.col("id")).alias("name"))


@query(
    """select id, case step when 'k1' then 'bg-danger' when 'k2' then 'bg-warning' when 'k3' then 'bg-success' else 'bg-secondary' end as step_class,
    case step when 'k1' then 'pencil-fill' when 'k2' then 'journals' when 'k3' then 'check-circle-fill' else 'archive-fill' end as step_icon,
    case when ocr_status = 'done' and ocr_confidence <> 0 then cast(round_even(ocr_confidence * 100, 0) as int) || '%' end as percent,
    case when length(note) > 50 then substr(note, 1, 50) || '...' else note end as note_preview from document"""
)
def badges(spark, sf_dir):
    c = F.col
    return document(spark, sf_dir).select("id", L.step_class(c("step")).alias("step_class"), L.step_icon(c("step")).alias("step_icon"), L.percent(c("ocr_status"), c("ocr_confidence")).alias("percent"), X.truncate(c("note"), 50).alias("note_preview"))


@query(
    """select id, 'Status OCR=' || case ocr_status when 'none' then 'Niewykonany' when 'pending' then 'Oczekuje' when 'running' then 'W trakcie' when 'done' then 'Zakończony' else 'Błąd' end
    || case when ocr_status = 'done' and ocr_confidence <> 0 then '|Pewność OCR=' || cast(round_even(ocr_confidence * 100, 0) as int) || '%' else '' end
    || '|Typ dokumentu=' || coalesce(nullif(doc_type, ''), 'Nieznany') || '|Data dodania=' || strftime(upload_time, '%Y-%m-%d %H:%M') as context from document"""
)
def context_rows(spark, sf_dir):
    c = F.col
    rows = L.context_rows(c("ocr_status"), c("ocr_confidence"), c("doc_type"), c("upload_time"))
    return document(spark, sf_dir).select("id", F.array_join(F.transform(rows, lambda r: F.concat(r["label"], F.lit("="), r["value"])), "|").alias("context"))


@query(
    """select id, concat_ws(',', 'download', case when ocr_status = 'none' and mime_type is distinct from 'text/plain' then 'run_ocr' end, case when ocr_status = 'done' then 'summarize' end, case when mime_type like '%word%' then 'update' end) as actions,
    case when mime_type like 'image/%' or mime_type = 'application/pdf' then 'file' when mime_type like '%word%' then 'word_preview' when mime_type = 'text/plain' or lower(original_filename) like '%.txt' then 'text_preview' else 'download' end as preview,
    case when lower(original_filename) like '%.pdf' then 'pdf' when lower(original_filename) like '%.png' then 'image' when lower(original_filename) like '%.docx' then 'word' when lower(original_filename) like '%.txt' then 'text' else 'unknown' end as client_kind,
    case when lower(original_filename) like '%.pdf' then 'application/pdf' when lower(original_filename) like '%.png' then 'image/png' when lower(original_filename) like '%.txt' then 'text/plain' else 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end as mime_by_name
from document"""
)
def actions_and_previews(spark, sf_dir):
    c = F.col
    return document(spark, sf_dir).select(
        "id", F.array_join(L.actions(c("ocr_status"), c("mime_type")), ",").alias("actions"), L.preview_target(c("mime_type"), c("original_filename")).alias("preview"), L.client_kind(c("original_filename")).alias("client_kind"), L.mime_of(c("original_filename")).alias("mime_by_name")
    )


# Changes

_GONE = "(select id from document where id % 40 = 0 or id % 70 = 13)"


def _ids(spark, sf_dir):
    return document(spark, sf_dir).where("id % 40 = 0 or id % 70 = 13").select("id")


@query(f"select id from document where id not in {_GONE} and (parent_id is null or parent_id not in {_GONE})")
def cascade_delete(spark, sf_dir):
    return mutate.delete(document(spark, sf_dir), _ids(spark, sf_dir)).select("id")


@query(f"select g.id, 1 + (select count(*) from document c where c.parent_id = g.id) as rows from {_GONE} g")
def deleted_counts(spark, sf_dir):
    return mutate.deleted_counts(document(spark, sf_dir), _ids(spark, sf_dir))


@query("select o.id, o.ocr_parent_id from document o where o.id % 13 <> 0 and o.ocr_parent_id is not null and not exists (select 1 from document d where d.id % 13 <> 0 and d.id = o.ocr_parent_id)")
def orphan_ocr_rows(spark, sf_dir):
    return mutate.orphans(document(spark, sf_dir).where("id % 13 <> 0")).select("id", "ocr_parent_id")


@query(
    f"""select id, doc_type, ocr_parent_id, original_filename, ocr_confidence from document where not (coalesce(doc_type = 'OCR TXT', false) and coalesce(ocr_parent_id % 20 = 3, false))
union all select 1000000000 + id, 'OCR TXT', id, regexp_replace(original_filename, '\\.[^./]+$', '') || '.txt', 0.5e0 from document where id % 20 = 3"""
)
def replace_ocr_text(spark, sf_dir):
    docs = document(spark, sf_dir).drop("text")
    new = docs.where("id % 20 = 3").select((F.col("id") + 1_000_000_000).alias("id"), F.col("id").alias("ocr_parent_id"), F.lit(0.5).alias("ocr_confidence"), F.lit(NOW).cast("timestamp_ntz").alias("upload_time"))
    return mutate.replace_ocr(docs, new).select("id", "doc_type", "ocr_parent_id", "original_filename", "ocr_confidence")


@query(
    f"""select id, parent_id, doc_type, case when id % 30 = 0 then 'nowy.docx' else original_filename end as original_filename, upload_time, case when id % 30 = 0 then TIMESTAMP '{NOW}' else last_modified end as last_modified from document
union all select 1000000000 + id, id, 'Archiwalna wersja', original_filename || ' (wersja z 20240601_120000)', coalesce(last_modified, upload_time), null from document where id % 30 = 0 and stored_filename not like '%.empty'"""
)
def snapshot_history(spark, sf_dir):
    docs = document(spark, sf_dir).drop("text")
    updates = docs.where("id % 30 = 0").select("id", F.lit("nowy.docx").alias("original_filename"), F.lit("n.docx").alias("stored_filename"), (F.col("id") + 1_000_000_000).alias("history_id"), F.lit("").alias("comments"))
    return mutate.replace_file(docs, updates, NOW, "20240601_120000").select("id", "parent_id", "doc_type", "original_filename", "upload_time", "last_modified")


@query("select id, case when id % 4 = 0 then 'k4' else step end as step, case when id % 4 = 0 then nullif(case when id % 8 = 0 then '' else 'Akta' end, '') else doc_type end as doc_type, case when id % 4 = 0 then 'X' else sygnatura end as sygnatura from document")
def metadata_update(spark, sf_dir):
    docs = document(spark, sf_dir).drop("text")
    changes = docs.where("id % 4 = 0").select("id", F.lit("k4").alias("step"), F.when(F.col("id") % 8 == 0, "").otherwise("Akta").alias("doc_type"), F.lit("X").alias("sygnatura"))
    return mutate.update_metadata(docs, changes).select("id", "step", "doc_type", "sygnatura")


@query(r"select id, nullif(regexp_replace(note, '^\s+|\s+$', '', 'g'), '') as note from document")
def note_update(spark, sf_dir):
    docs = document(spark, sf_dir).drop("text")
    return mutate.update_note(docs, docs.select("id", "note")).select("id", "note")


@query(
    """select 1000000000 + id as id, sygnatura, doc_type, step, cast(null as bigint) as parent_id, true as is_main, 'none' as ocr_status from document where false
union all select 1000000000 + d.id, d.sygnatura, 'Załącznik', d.step, d.id, false, 'pending' from document d where d.is_main and d.id % 20 = 0
union all select 2000000000 + d.id, d.sygnatura, 'Opinia', 'k1', null, true, 'none' from document d where d.is_main and d.id % 20 = 0"""
)
def upload_children(spark, sf_dir):
    docs = document(spark, sf_dir).drop("text")
    own = docs.where("is_main and id % 20 = 0")
    time = F.lit(NOW).cast("timestamp_ntz").alias("upload_time")
    files = [(1_000_000_000, "Załącznik", "skan.PDF"), (2_000_000_000, "Opinia", "opinia.docx"), (3_000_000_000, "Inne", "program.exe")]
    uploads = [own.select((F.col("id") + n).alias("id"), F.col("id").alias("case_id"), F.lit(kind).alias("doc_type"), F.lit(name).alias("original_filename"), F.lit("f").alias("stored_filename"), time) for n, kind, name in files]
    new = mutate.new_children(docs, uploads[0].union(uploads[1]).union(uploads[2]))
    return new.select("id", "sygnatura", "doc_type", "step", "parent_id", "is_main", "ocr_status")


# Queue and status

_EVENTS = """with e as (select user_id as id, ts, event_id, value as progress, case event_type when 'signup' then 'pending' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'done' when 'error' then 'fail' end as status from events), s as (select * from e where status is not null)"""


@query("select id, arg_max(status, (ts, event_id)) as status, round(arg_max(case when status = 'pending' then 0e0 else progress end, (ts, event_id)) filter (progress is not null or status = 'pending'), 6) as progress, max(ts) as ts, count(*) as events from s group by id", _EVENTS)
def event_latest_status(spark, sf_dir):
    return tasks.latest_status(status_events(spark, sf_dir)).select("id", "status", F.round("progress", 6).alias("progress"), F.col("ts").cast("timestamp_ntz").alias("ts"), "events")


@query(
    """select id, event_id from (select *, sum(case when status in ('done', 'fail') then 1 else 0 end) over (partition by id order by ts, event_id rows unbounded preceding) as flight from s) where status = 'pending'
qualify row_number() over (partition by id, flight order by ts, event_id) = 1""",
    _EVENTS,
)
def queue_admissions(spark, sf_dir):
    return tasks.admitted(status_events(spark, sf_dir)).select("id", "event_id")


@query("select date_trunc('hour', ts) as start, status, count(*) as events from s group by all", _EVENTS)
def event_activity(spark, sf_dir):
    return tasks.activity(status_events(spark, sf_dir)).select(F.col("start").cast("timestamp_ntz").alias("start"), "status", "events")


_REPORTS = """, r as (select id, ts, event_id, status, case when status = 'pending' then 0e0 when event_id % 3 <> 0 then progress end as progress,
    case when status = 'pending' then 'Oczekuje w kolejce' when event_id % 4 <> 0 then 'zdarzenie ' || event_id end as info,
    case when event_id % 2 = 0 then cast(event_id % 7 as int) end as current_page, case when event_id % 5 <> 0 then 7 end as total_pages, case when status = 'done' then (event_id % 11) / 10e0 end as confidence from s)"""


def _reports(spark, sf_dir):
    """Status events with everything that one may report."""
    e = F.col("event_id")
    return status_events(spark, sf_dir).withColumns(
        {
            "progress": F.when(e % 3 != 0, F.col("progress")),
            "info": F.when(e % 4 != 0, F.concat(F.lit("zdarzenie "), e.cast("string"))),
            "current_page": F.when(e % 2 == 0, (e % 7).cast("int")),
            "total_pages": F.when(e % 5 != 0, F.lit(7)),
            "confidence": F.when(F.col("status") == "done", e % 11 / 10),
        }
    )


_FOLD = """select id, arg_max(status, (ts, event_id)) as status, round(arg_max(progress, (ts, event_id)) filter (progress is not null), 6) as progress, arg_max(info, (ts, event_id)) filter (info is not null) as info,
    arg_max(current_page, (ts, event_id)) filter (progress is not null and current_page is not null and total_pages is not null) as current_page, arg_max(total_pages, (ts, event_id)) filter (progress is not null and current_page is not null and total_pages is not null) as total_pages,
    arg_max(confidence, (ts, event_id)) filter (confidence is not null) as confidence from r group by id"""


@query(_FOLD, _EVENTS + _REPORTS)
def status_fold(spark, sf_dir):
    return tasks.latest_status(_reports(spark, sf_dir)).select("id", "status", F.round("progress", 6).alias("progress"), "info", "current_page", "total_pages", "confidence")


@query(
    f"""select d.id, coalesce(f.status, ocr_status) as ocr_status, round(coalesce(f.progress, ocr_progress), 6) as ocr_progress, round(coalesce(f.confidence, ocr_confidence), 6) as ocr_confidence
from document d left join ({_FOLD}) f on f.id = d.id""",
    f"{_EVENTS}{_REPORTS}, document as (select {DUCKDB_ROWS} from documents)",
)
def status_applied(spark, sf_dir):
    """The document table after all reports."""
    d = document(spark, sf_dir).select("id", "ocr_status", "ocr_progress", "ocr_confidence")
    return tasks.apply_status(d, tasks.latest_status(_reports(spark, sf_dir))).select("id", "ocr_status", F.round("ocr_progress", 6).alias("ocr_progress"), F.round("ocr_confidence", 6).alias("ocr_confidence"))


@query(f"select id, TIMESTAMP '{NOW}' as ts, status, 0e0 as progress from (select id, 'pending' as status from document where ocr_status = 'fail')")
def rerun_events(spark, sf_dir):
    return tasks.rerun(document(spark, sf_dir).where("ocr_status = 'fail'").select("id"), NOW, 1).select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "progress")


# Records, classes and checks


@query(
    """select id, ocr_status as status, coalesce(ocr_progress, 0e0) as progress, case when id % 3 = 0 then 'strona ' || id else '' end as info, coalesce(case when id % 4 = 0 then cast(id % 9 as int) end, 0) as current_page, 0 as total_pages, ocr_confidence as confidence,
    ocr_status = 'done' as ocr_done, cast(floor(coalesce(ocr_progress, 0e0) * 100 + 0.5e0) as int) as percent from document"""
)
def progress_records(spark, sf_dir):
    """What pages poll: the records of progress and status."""
    extra = {"ocr_progress_info": F.when(F.col("id") % 3 == 0, F.concat(F.lit("strona "), F.col("id").cast("string"))), "ocr_current_page": F.when(F.col("id") % 4 == 0, (F.col("id") % 9).cast("int")), "ocr_total_pages": F.lit(None).cast("int")}
    d = document(spark, sf_dir).drop("text").withColumns(extra).select("id", L.progress_record().alias("p"), L.status_record().alias("s"))
    return d.select("id", "p.*", "s.ocr_done", L.progress_percent(F.col("p.progress")).alias("percent"))


_ENDINGS = (".pdf", ".PNG", ".jpeg", ".gif", ".tif", ".tiff", ".webp", ".txt", ".doc", ".DOCX", ".log", "")
_NAMED = "(select id, 'akta.' || id || [" + ", ".join(f"'{e}'" for e in _ENDINGS) + "][id % 12 + 1] as name, stored_filename from document)"


@query(
    f"""select id, case when e in ('.jpg', '.jpeg', '.png', '.tif', '.tiff', '.bmp', '.webp') then 'image' when e = '.pdf' then 'pdf' when e in ('.doc', '.docx') then 'word' when e = '.txt' then 'text' end as server_kind,
    e in ('.pdf', '.png', '.jpg', '.jpeg', '.gif', '.bmp', '.tiff') as quick, e in ('.pdf', '.jpg', '.jpeg', '.png', '.tif', '.tiff', '.bmp', '.webp', '.txt', '.doc', '.docx') as allowed,
    regexp_replace(name, '\\.[^./]+$', '') || '_tekst.txt' as text_name, stored_filename like 'history/%' as archived
from (select *, lower(regexp_extract(name, '\\.[^./]+$')) as e from {_NAMED})"""
)
def file_classes(spark, sf_dir):
    """Classes of file names by their endings."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("id") % 12 + 1).cast("int"))
    d = document(spark, sf_dir).select("id", F.concat(F.lit("akta."), F.col("id").cast("string"), ending).alias("name"), "stored_filename")
    n = F.col("name")
    return d.select("id", L.server_kind(n).alias("server_kind"), L.quick_allowed(n).alias("quick"), L.allowed(n).alias("allowed"), L.stem_with(n, "_tekst.txt").alias("text_name"), L.in_history(F.col("stored_filename")).alias("archived"))


@query(
    """select id, id % 9 between 1 and 7 as on_page, case when ok then round(least(ax, bx) / w, 6) end as x1, case when ok then round(least(ay, b_y) / h, 6) end as y1, case when ok then round(greatest(ax, bx) / w, 6) end as x2, case when ok then round(greatest(ay, b_y) / h, 6) end as y2,
    coalesce(ok and abs(least(ax, bx) / w) < 0.01 and abs(least(ay, b_y) / h) < 0.01 and abs(greatest(ax, bx) / w - 1) < 0.01 and abs(greatest(ay, b_y) / h - 1) < 0.01, false) as whole
from (select *, abs(ax - bx) >= 10 and abs(ay - b_y) >= 10 as ok from (select id, 800e0 as w, 600e0 as h, case when id % 6 = 0 then 0e0 else id * 37 % 800 end as ax, case when id % 6 = 0 then 0e0 else id * 53 % 600 end as ay, case when id % 6 = 0 then 800e0 else id * 91 % 800 end as bx, case when id % 6 = 0 then 600e0 else id * 17 % 600 end as b_y from document))"""
)
def selections(spark, sf_dir):
    """Selections on a page in pixels, as shares of it."""
    i, whole = F.col("id"), F.col("id") % 6 == 0
    corner = lambda k, most, else_: F.when(whole, F.lit(else_)).otherwise(i * k % most).cast("double")
    s = L.selection(corner(37, 800, 0), corner(53, 600, 0), corner(91, 800, 800), corner(17, 600, 600), F.lit(800.0), F.lit(600.0))
    d = document(spark, sf_dir).select("id", *(c.alias(n) for n, c in s.items()))
    return d.select("id", L.on_page(i % 9, F.lit(7)).alias("on_page"), *(F.round(n, 6).alias(n) for n in s), F.coalesce(L.whole_page(*(F.col(n) for n in s)), F.lit(False)).alias("whole"))


@query("select count(*) as files, sum(strlen(text)) as bytes, max(strlen(text)) <= 52428800 and sum(strlen(text)) <= 209715200 as ok from document")
def upload_limits(spark, sf_dir):
    return files.within_limits(document(spark, sf_dir).select(F.octet_length("text").cast("long").alias("length")))


@query(
    """select id, round(0.2e0 + 0.7e0 * (id % 9 + 1) / 9, 6) as page_progress, case when id % 3 = 0 then coalesce(note, '') || chr(10) || '[2024-06-01 12:00] Aktualizacja: nowa wersja' else note end as note,
    text || chr(10) || chr(10) || '--- Dodany fragment ---' || chr(10) || step as with_fragment, replace(text, chr(10), '<br>') as shown,
    regexp_replace(regexp_replace(regexp_replace('art ' || id || ' i start  ' || id || ', Art' || chr(160) || '7, §  ' || id, 'art[\\s\\x{00A0}]+(\\d+)', 'art. \\1', 'g'), 'Art[\\s\\x{00A0}]+(\\d+)', 'Art. \\1', 'g'), '§[\\s\\x{00A0}]+(\\d+)', '§ \\1', 'g') as law,
    case id % 4 when 0 then 'c' when 1 then '' when 2 then null else 't' end as answer from document"""
)
def texts_and_marks(spark, sf_dir):
    """Progress of pages, notes after an update, fragments, line ends, law spacing and answers of a language model."""
    c, i = F.col, F.col("id")
    law = F.concat(F.lit("art "), i.cast("string"), F.lit(" i start  "), i.cast("string"), F.lit(", Art\u00a07, §  "), i.cast("string"))
    json = F.when(i % 4 == 0, '{"response": "r", "content": "c"}').when(i % 4 == 1, '{"text": "t", "response": ""}').when(i % 4 == 2, '{"other": "x"}').otherwise('{"text": "t"}')
    return document(spark, sf_dir).select(
        "id",
        F.round(L.page_progress(i % 9 + 1, F.lit(9)), 6).alias("page_progress"),
        F.when(i % 3 == 0, L.note_with_comment(c("note"), "nowa wersja", NOW[:16])).otherwise(c("note")).alias("note"),
        L.with_fragment(c("text"), c("step")).alias("with_fragment"),
        L.with_breaks(c("text")).alias("shown"),
        X.law_spacing(law).alias("law"),
        L.first_present(json).alias("answer"),
    )


@query("select id, md5(replace(text, chr(13), '')) as text_md5 from document")
def decoded_texts(spark, sf_dir):
    """Texts from their bytes, with CR LF for line ends."""
    d = document(spark, sf_dir).select("id", F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8").alias("content"))
    return d.select("id", F.md5(contents.decoded("content").cast("binary")).alias("text_md5"))


@query(f", {_PAGES}\nselect doc_id, page, cast(floor((page - 1) / 5) as int) as batch from pages_of")
def page_batches(spark, sf_dir):
    return ocr.batches_of(ocr.text_pages(document(spark, sf_dir))).select("doc_id", F.col("page").cast("long").alias("page"), "batch")


# New rows and exports


def _uploads(spark, sf_dir, where):
    time = F.lit(NOW).cast("timestamp_ntz").alias("upload_time")
    return document(spark, sf_dir).where(where).select((F.col("id") + 1_000_000_000).alias("id"), "original_filename", "stored_filename", time)


@query("select 1000000000 + id as id, original_filename, 'k1' as step, 'none' as ocr_status, 'opinion' as content_type, 'Opinia' as doc_type, 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' as mime_type, true as is_main, cast(null as bigint) as parent_id from document where is_main")
def uploaded_cases(spark, sf_dir):
    return mutate.new_cases(_uploads(spark, sf_dir, "is_main")).select("id", "original_filename", "step", "ocr_status", "content_type", "doc_type", "mime_type", "is_main", "parent_id")


@query(
    """select id, original_filename, error from (
    select 1000000000 + id as id, original_filename, case when id >= first then 'Opinie muszą być w formacie Word (.doc, .docx)' end as error
    from document, (select min(id) as first from document where not is_main and id > 120) where is_main or id > 120)"""
)
def partial_upload(spark, sf_dir):
    """Uploads are taken up to the first that is no Word file."""
    return mutate.taken(_uploads(spark, sf_dir, "is_main or id > 120")).select("id", "original_filename", "error")


@query("select 2000000000 + id as id, 'Nowa opinia' as original_filename, (2000000000 + id) || '.empty' as stored_filename, step, 'none' as ocr_status, 'opinion' as content_type, doc_type, sygnatura, case when note <> '' then regexp_replace(note, '^\\s+|\\s+$', '', 'g') end as note, true as is_main, cast(null as varchar) as creator from document where is_main")
def empty_cases(spark, sf_dir):
    new = document(spark, sf_dir).where("is_main").select((F.col("id") + 2_000_000_000).alias("id"), "sygnatura", "doc_type", "step", "note", F.lit(NOW).cast("timestamp_ntz").alias("upload_time"))
    return mutate.empty_cases(new).select("id", "original_filename", "stored_filename", "step", "ocr_status", "content_type", "doc_type", "sygnatura", "note", "is_main", "creator")


@query("select 1000000000 + id as id, mime_type, case when mime_type like 'image/%' then 'image' else 'document' end as content_type, cast(77 as bigint) as parent_id, 'k1' as step, 'pending' as ocr_status, false as is_main from document where not is_main")
def quick_upload_rows(spark, sf_dir):
    """Word files among the uploads are skipped."""
    return mutate.quick_uploads(_uploads(spark, sf_dir, "true"), 77).select("id", "mime_type", "content_type", "parent_id", "step", "ocr_status", "is_main")


@query(f"select id, doc_type from document union all select 1000000001, '{mutate.CONTAINER}'")
def container_row(spark, sf_dir):
    """The container is added once, however often it is asked for."""
    d = document(spark, sf_dir).select("id", "doc_type", "is_main")
    one = d.limit(0).unionByName(spark.range(1).select((F.col("id") + 1_000_000_001).alias("id"), F.lit(mutate.CONTAINER).alias("doc_type"), F.lit(True).alias("is_main")))
    return mutate.with_container(mutate.with_container(d, one), one.withColumn("id", F.col("id") + 1)).select("id", "doc_type")


_EDITED = "select id + 3000000000 as id, id as source_id, 'tekst ' || id as text from document where id % 10 in (3, 7)"


@query(
    f"""select d.id, d.doc_type, d.ocr_parent_id, case when d.ocr_status = 'none' and e.source_id is not null and l.id is null then 'done' else d.ocr_status end as ocr_status, md5(coalesce(k.text, d.text)) as text_md5, case when k.text is not null then TIMESTAMP '{NOW}' else d.last_modified end as last_modified
from document d left join ({_EDITED}) e on e.source_id = d.id left join ({_LATEST}) l on l.ocr_parent_id = d.id left join (select x.id, y.text from ({_LATEST}) x join ({_EDITED}) y on y.source_id = x.ocr_parent_id) k on k.id = d.id
union all select e.id, 'OCR TXT', e.source_id, 'done', md5(e.text), null from ({_EDITED}) e where not exists (select 1 from ({_LATEST}) l where l.ocr_parent_id = e.source_id)"""
)
def manual_texts(spark, sf_dir):
    """Texts typed in: those of known sources are changed, others made."""
    d = document(spark, sf_dir)
    edits = d.where("id % 10 in (3, 7)").select((F.col("id") + 3_000_000_000).alias("id"), F.col("id").alias("source_id"), F.concat(F.lit("tekst "), F.col("id").cast("string")).alias("text"))
    return mutate.save_manual_text(d, edits, NOW).select("id", "doc_type", "ocr_parent_id", "ocr_status", F.md5(F.col("text").cast("binary")).alias("text_md5"), "last_modified")


@query(
    rf"""select id, case when id % 4 <> 0 then note when coalesce(regexp_replace(note, '\s+', '', 'g'), '') = '' then s else s || chr(10) || chr(10) || '---' || chr(10) || chr(10) || note end as note
from (select id, note, '[PODSUMOWANIE AI - {NOW[:16]}]' || chr(10) || 'Streszczenie ' || id as s from document)"""
)
def saved_summaries(spark, sf_dir):
    d = document(spark, sf_dir).select("id", "note")
    found = d.select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("Streszczenie "), F.col("id").cast("string"))).alias("summary"))
    return mutate.save_summaries(d, found, NOW[:16], "prepend")


#: One text in three begins and ends with white space of several kinds, and all have line ends, quotes or commas somewhere.
_SHOWN = "id, sygnatura, note, case when id % 3 = 0 then chr(10) || chr(160) || ' ' || text || chr(8201) || chr(13) || chr(10) else text end as tekst"
_FIELDS = ("id", "sygnatura", "note", "tekst")


def _lines(field: str) -> str:
    each = " || ',' || ".join(field.replace("{0}", f"coalesce(cast({c} as varchar), '')") for c in _FIELDS)
    return f"select {each} as value from (select {_SHOWN} from document)"


def _shown(spark, sf_dir):
    spaced = F.concat(F.lit("\n\u00a0 "), "text", F.lit("\u2009\r\n"))
    return document(spark, sf_dir).select("id", "sygnatura", "note", F.when(F.col("id") % 3 == 0, spaced).otherwise(F.col("text")).alias("tekst"))


@query("select 'id,sygnatura,note,tekst' as value union all " + _lines("case when regexp_matches({0}, '[,\"\\r\\n]') then '\"' || replace({0}, '\"', '\"\"') || '\"' else {0} end"))
def export_csv_lines(spark, sf_dir):
    d = _shown(spark, sf_dir)
    return spark.range(1).select(sinks.heading(d, sinks.minimal).alias("value")).union(sinks.body(d, sinks.minimal))


@query("select '\"id\",\"sygnatura\",\"note\",\"tekst\"' as value union all " + _lines("'\"' || replace(trim(regexp_replace({0}, '" + X.WHITE + "+', ' ', 'g')), '\"', '\"\"') || '\"'"))
def export_quoted_lines(spark, sf_dir):
    d = _shown(spark, sf_dir)
    return spark.range(1).select(sinks.heading(d, sinks.always).alias("value")).union(sinks.body(d, sinks.always))


@query("select 'id,sygnatura,note,tekst' as value union all " + _lines("replace(regexp_replace(regexp_replace({0}, '^" + X.WHITE + "+|" + X.WHITE + "+$', '', 'g'), '[\\r\\n]+', ' ', 'g'), ',', ';')"))
def export_plain_lines(spark, sf_dir):
    d = _shown(spark, sf_dir)
    return spark.range(1).select(sinks.heading(d, sinks.never).alias("value")).union(sinks.body(d, sinks.never))


# Queries of other modules register themselves here.

from . import file_queries, text_queries  # noqa: E402, F401
