"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derive
from touchline.functions.text import normalized
from touchline.operators import consolidate, feed, matching, results, script_pages, table_pages
from touchline.operators.carry import carry_forward as carry
from touchline.plans.results import consolidated_events, extract_results
from touchline.session import shared_dir
from touchline.sources import config, logs, pages
from touchline.sources import log_records as log_records_of
from touchline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

_RESULT = ["page_id", "pos", "date", "name", "score"]


# --- sources ----------------------------------------------------------------------------


def read_leagues(spark: SparkSession, sf: str) -> DataFrame:
    files = derive.table(spark, sf, "customer").selectExpr(
        "c_custkey div 100 as block",
        """struct(c_custkey, named_struct('code', c_name,
            'bbcName', if(c_nationkey % 4 = 0, null, lower(c_mktsegment)),
            'thefishyId', c_nationkey, 'rounds', 1, 'isActive', c_acctbal > 0) as e) as item""",
    ).groupBy("block").agg(
        F.expr("to_json(transform(array_sort(collect_list(item)), i -> i.e)) as value")
    )
    read = config.decode_leagues(files)
    return read.select(
        "code", "bbcName", "thefishyId", "rounds", F.col("isActive").cast("int").alias("active"),
        "league_idx",
    )


def read_entities(spark: SparkSession, sf: str) -> DataFrame:
    return config.decode_entities(derive.entity_files(spark, sf), derive.leagues(spark, sf))


def missing_dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    return config.missing_files(derive.entity_files(spark, sf), derive.leagues(spark, sf))


def landing_pages(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "landing")
    pages.write_pages(derive.fetched_pages(spark, sf), path)
    read = pages.read_pages(spark, path)
    return read.groupBy("source", "league").agg(
        F.count("*").alias("pages"), F.sum(F.length("body")).alias("chars"),
        F.sum("page_id").alias("ids"),
    )


def stream_pages(spark: SparkSession, sf: str) -> DataFrame:
    landing, out = shared_dir(spark, "landing"), shared_dir(spark, "arrived")
    pages.write_pages(derive.fetched_pages(spark, sf), landing)
    (
        pages.stream_pages(spark, landing, max_files=10)
        .select("page_id", "source", "league", "status", F.length("body").alias("chars"))
        .writeStream.option("checkpointLocation", shared_dir(spark, "state"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.schema(
        "page_id long, source string, league string, status int, chars int"
    ).parquet(out)


def unwrap_html(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = derive.table(spark, sf, "pages").selectExpr(
        "page_id",
        """case page_id % 5 when 3 then '{"other":1}' when 4 then '{"html":""}'
           else to_json(struct(html)) end as body""",
    )
    return pages.unwrap_html(wrapped, "body").select("page_id", F.md5("body").alias("digest"))


def fetch_triage(spark: SparkSession, sf: str) -> DataFrame:
    ok, rejected = pages.fetch_triage(derive.fetched_pages(spark, sf))
    return ok.selectExpr("page_id", "'ok' as route", "'' as reason").unionByName(
        rejected.select("page_id", "route", "reason")
    )


def crawl_plan(spark: SparkSession, sf: str) -> DataFrame:
    leagues = derive.table(spark, sf, "customer").selectExpr(
        "c_name as code", "if(c_nationkey % 4 = 0, null, lower(c_mktsegment)) as bbcName",
        "if(c_nationkey % 5 = 0, null, c_nationkey) as thefishyId", "int(c_custkey) as league_idx",
    )
    return pages.crawl_table(leagues, pages.SOURCES, "2025-03-09", cycles=3)


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    urls = derive.table(spark, sf, "pages").selectExpr(
        "page_id",
        """case page_id % 9 when 5 then substring_index(url, '://', -1)
            when 6 then replace(url, '.example.', '.example:8080/')
            when 7 then concat('ftp', url) else url end as url""",
    )
    return pages.url_parts(urls, "url")


# --- page extraction --------------------------------------------------------------------


def script_assignment(spark: SparkSession, sf: str) -> DataFrame:
    value = script_pages.script_assignment(F.col("html"), "var t")
    return derive.table(spark, sf, "pages").select("page_id", value.alias("value"))


def first_key_like(spark: SparkSession, sf: str) -> DataFrame:
    json = F.expr(
        """concat('{"data":{"z', event_id, '":1,"', event_type, '-', user_id, '":', props,
           ',"signup-0":2,"view-1":[]}}')"""
    )
    return derive.table(spark, sf, "events").select(
        "event_id", script_pages.first_key_like(json, "i").alias("first_key")
    )


def fixture_events(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = script_pages.extract_script_results(derive.order_script_pages(spark, sf))
    return found.select(*_RESULT)


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table_pages.table_rows(derive.order_table_pages(spark, sf))
    return rows.select("page_id", "pos", "css_class", F.md5("content").alias("digest"))


def table_results(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = table_pages.extract_table_results(derive.order_table_pages(spark, sf))
    return found.select(*_RESULT)


def table_results_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """The same pages with angle brackets in quoted attribute values of every kind of tag."""
    pages = derive.order_table_pages(spark, sf)
    for tag, value in (
        ("table", 'title="a > b"'), ("tr", "data-x='</table>'"), ("td", 'title="<tr class=cats>"'),
        ("a", 'rel = "1 > 0" data-y=\'"<a>"\''),
    ):
        pages = pages.withColumn("body", F.replace("body", F.lit(f"<{tag} "), F.lit(f"<{tag} {value} ")))
    pages = pages.withColumn("body", F.replace("body", F.lit("<td>"), F.lit('<td title="</td>">')))
    found, _ = table_pages.extract_table_results(pages)
    return found.select(*_RESULT)


def parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    _, errors = extract_results(_odd_pages(spark, sf))
    return errors.groupBy("source", "reason").agg(
        F.count("*").alias("n"), F.sum("page_id").alias("ids")
    )


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    events = derive.table(spark, sf, "events").select(
        F.when(F.col("user_id") % 50 != 0, F.col("user_id")).alias("user_id"), "event_id",
        "event_type", "value",
    )
    return carry(
        events, ["user_id"], ["event_id"], F.col("event_type") == "signup",
        F.when(F.col("value") >= 2, F.col("value")), F.expr("event_id div 1000"), "current",
    ).select("event_id", "user_id", "current")


def collapse_repeats(spark: SparkSession, sf: str) -> DataFrame:
    lines = derive.table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "int(l_quantity) as quantity", "string(to_date(l_shipdate)) as date"
    )
    return table_pages.collapse_repeats(lines, ["l_partkey", "quantity"])


# --- matching ---------------------------------------------------------------------------


def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    return derive.table(spark, sf, "documents").select(
        "doc_id", normalized(F.col("text")).alias("norm")
    )


def _resolved(spark: SparkSession, sf: str, operator, size: int, **options) -> DataFrame:
    return operator(
        derive.entity_texts(spark, sf, size), derive.aliases(spark, sf, size), **options
    )


def _matcher(operator, size: int = derive.LEAGUE_PARTS, **options) -> Query:
    return lambda spark, sf: _resolved(spark, sf, operator, size, **options)


def split_matchups(spark: SparkSession, sf: str) -> DataFrame:
    parts = results.split_matchup(F.col("name"))
    return derive.fixtures(spark, sf).select(
        "page_id", "pos", parts[0].alias("home"), parts[1].alias("away")
    )


def resolve_matchups(spark: SparkSession, sf: str) -> DataFrame:
    matched, _ = results.resolve_matchups(derive.fixtures(spark, sf), derive.aliases(spark, sf))
    return matched.select("page_id", "source", "league", *_RESULT[1:])


def match_batch(spark: SparkSession, sf: str) -> DataFrame:
    matched, _ = results.match_batch(derive.fixtures(spark, sf), derive.aliases(spark, sf))
    return matched


def unmatched(spark: SparkSession, sf: str) -> DataFrame:
    _, rest = results.match_batch(derive.fixtures(spark, sf), derive.aliases(spark, sf))
    return rest.select("page_id", "league", "pos", "name")


def attach_canonical(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive.fixtures(spark, sf)
    names = results.resolve_names(rows, derive.aliases(spark, sf))
    return results.attach_canonical(rows, names).select("page_id", "pos", "league", "name", "score")


def match_report(spark: SparkSession, sf: str) -> DataFrame:
    return results.match_report(
        results.annotate_matchups(derive.fixtures(spark, sf), derive.aliases(spark, sf)), texts=True
    )


def unmatched_names(spark: SparkSession, sf: str) -> DataFrame:
    return results.unmatched_names(
        results.annotate_matchups(derive.fixtures(spark, sf), derive.aliases(spark, sf))
    )


def league_lookup(spark: SparkSession, sf: str) -> DataFrame:
    part = derive.table(spark, sf, "part")
    leagues = part.selectExpr(
        f"'L' || (p_partkey * 7 % (p_partkey div {derive.LEAGUE_PARTS} + 1)) as code",
        "p_brand as bbcName", "int(p_partkey) as league_idx",
    )
    codes = part.selectExpr(f"'L' || p_partkey div {derive.LEAGUE_PARTS * 2} * 3 as code")
    return results.league_lookup(codes, leagues, derive.aliases(spark, sf))


# --- consolidation ----------------------------------------------------------------------


def _events_out(events: DataFrame) -> DataFrame:
    return events.select(
        "league", "name", "date", "bbc_score", "fishy_score",
        F.unix_millis("created_at").alias("created_ms"),
        F.unix_millis("updated_at").alias("updated_ms"),
    )


def _consolidated(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate.consolidate_scores(derive.event_results(spark, sf))


def consolidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _events_out(_consolidated(spark, sf))


def _event_batch(spark: SparkSession, sf: str, part: int) -> DataFrame:
    """One of five batches of consolidated results."""
    rows = derive.event_results(spark, sf).filter(F.col("page_id") % 5 == part)
    return consolidate.consolidate_scores(rows)


def _stored(spark: SparkSession, sf: str) -> str:
    """An event table of two writers with batches 0 and 1 each, a replay, and one more."""
    table = shared_dir(spark, "events")
    for part, (writer, batch_id) in enumerate((("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2))):
        consolidate.upsert_events(_event_batch(spark, sf, part), batch_id, table, writer)
    consolidate.upsert_events(_event_batch(spark, sf, 1), 0, table, "b")
    return table


def all_events(spark: SparkSession, sf: str) -> DataFrame:
    """The table rewritten to a new place, with a batch that arrives afterwards."""
    old, new = shared_dir(spark, "events"), shared_dir(spark, "events")
    for part in range(4):
        consolidate.upsert_events(_event_batch(spark, sf, part), part, old)
    consolidate.rewrite_events(spark, old, new)
    consolidate.upsert_events(_event_batch(spark, sf, 4), 4, new)
    return _events_out(consolidate.all_events(spark, new))


def purge_events(spark: SparkSession, sf: str) -> DataFrame:
    """Batches, a purge up to ten days before the last date, a replay and a late batch."""
    table = shared_dir(spark, "events")
    for part in range(4):
        consolidate.upsert_events(_event_batch(spark, sf, part), part, table)
    last = derive.event_results(spark, sf).agg(F.date_sub(F.max(F.to_date("date")), 10).cast("string"))
    consolidate.purge_events(spark, table, last.first()[0])
    consolidate.upsert_events(_event_batch(spark, sf, 2), 2, table)
    consolidate.upsert_events(_event_batch(spark, sf, 4), 4, table)
    return _events_out(consolidate.read_events(spark, table))


def _landed_results(spark: SparkSession, sf: str) -> str:
    path = shared_dir(spark, "results")
    derive.event_results(spark, sf).repartition(4, "page_id").write.parquet(path)
    return path


def consolidate_stream(spark: SparkSession, sf: str) -> DataFrame:
    path, table = _landed_results(spark, sf), shared_dir(spark, "events")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    jobs.consolidate_stream(source, table, shared_dir(spark, "state")).awaitTermination()
    return _events_out(consolidate.read_events(spark, table))


def upsert_events(spark: SparkSession, sf: str) -> DataFrame:
    return _events_out(consolidate.read_events(spark, _stored(spark, sf)))


def events_for_league(spark: SparkSession, sf: str) -> DataFrame:
    return _events_out(consolidate.events_for_league(spark, _stored(spark, sf), "purchase"))


def count_by_league(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate.count_by_league(consolidate.read_events(spark, _stored(spark, sf)))


def league_feed(spark: SparkSession, sf: str) -> DataFrame:
    codes = derive.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("none-"), F.col("user_id") % 7))
        .when(F.col("event_type") != "view", F.col("event_type")).alias("code")
    ).filter("code is not null")
    return feed.league_feed(consolidate.read_events(spark, _stored(spark, sf)), codes)


def league_feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents written to files and read back; one league has the empty code."""
    events = _consolidated(spark, sf).withColumn("league", F.nullif("league", F.lit("view")))
    events = events.fillna("", ["league"])
    codes = derive.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", "").when(F.col("event_id") % 50 == 0, "none/1")
        .otherwise(F.col("event_type")).alias("code")
    )
    path = shared_dir(spark, "feed")
    feed.write_league_feed(feed.league_feed(events, codes), path)
    return feed.read_league_feeds(spark, path).select("league", "value")


def _odd_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of both sites, the given ones as fetched, and some of another source or of none."""
    source = F.when(F.col("page_id") % 20 == 8, "other").when(F.col("page_id") % 20 != 4, F.col("source"))
    return (
        derive.order_script_pages(spark, sf)
        .unionByName(derive.order_table_pages(spark, sf))
        .unionByName(derive.fetched_pages(spark, sf).withColumn("source", source))
    )


def pages_to_events(spark: SparkSession, sf: str) -> DataFrame:
    return _events_out(
        consolidated_events(derive.fixture_pages(spark, sf), derive.aliases(spark, sf))
    )


def _ingest(spark: SparkSession, sf: str, raw: DataFrame) -> tuple[str, str]:
    """Table and reports of a stream that takes the pages in four batches or more."""
    landing, table, reports = (shared_dir(spark, n) for n in ("landing", "events", "reports"))
    pages.write_pages(raw, landing)
    dictionary = shared_dir(spark, "aliases")
    derive.aliases(spark, sf).write.parquet(dictionary)
    _follow(spark, landing, 4, spark.read.parquet(dictionary), table, shared_dir(spark, "state"), reports)
    return table, reports


def _follow(
    spark: SparkSession, landing: str, batches: int, aliases, table: str, state: str, reports: str
) -> None:
    """Ingest what has landed and is not ingested yet, in so many batches or more."""
    files = spark.read.parquet(landing).select("_metadata.file_path").distinct().count()
    arriving = pages.stream_pages(spark, landing, max_files=max(1, files // batches))
    jobs.ingest_pages(arriving, aliases, table, state, reports=reports).awaitTermination()


def _renamed(aliases: DataFrame) -> DataFrame:
    """A later dictionary: entities of every other league have a longer name."""
    even = F.expr("int(substring(league, 2)) % 2 = 0")
    return aliases.withColumn("entity", F.when(even, F.concat("entity", F.lit(" FC"))).otherwise(F.col("entity")))


def _ingest_in_two(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Half of the pages, then a changed dictionary, then the other half through the same stream."""
    table, reports, state, dictionary = (shared_dir(spark, n) for n in ("events", "reports", "state", "aliases"))
    landing, raw = shared_dir(spark, "landing"), derive.fixture_pages(spark, sf)
    derive.aliases(spark, sf).write.parquet(f"{dictionary}/0")
    _renamed(spark.read.parquet(f"{dictionary}/0")).write.parquet(f"{dictionary}/1")
    for half in range(2):
        pages.write_pages(raw.filter(f"page_id % 16 div 8 = {half}"), landing)
        versions = lambda: spark.read.parquet(f"{dictionary}/{half}")  # noqa: B023, E731
        _follow(spark, landing, 2, versions, table, state, reports)
    return table, reports


def ingest_changed_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    table, _ = _ingest_in_two(spark, sf)
    return _events_out(consolidate.read_events(spark, table))


def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows parsed, and names resolved anew: each once a dictionary version, whatever the batches."""
    _, reports = _ingest_in_two(spark, sf)
    return jobs.read_reports(spark, reports, "counts").agg(
        F.sum("parsed").alias("parsed"), F.sum("failed").alias("failed"), F.sum("resolved").alias("resolved")
    )


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    _, reports = _ingest(spark, sf, derive.fixture_pages(spark, sf))
    return jobs.read_match_report(spark, reports)


def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    table, _ = _ingest(spark, sf, derive.fixture_pages(spark, sf))
    return _events_out(consolidate.read_events(spark, table))


def ingest_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    _, reports = _ingest(spark, sf, derive.fixture_pages(spark, sf))
    names = jobs.read_reports(spark, reports, "names")
    return names.filter("not hit").select("league", "name").distinct()


def ingest_errors(spark: SparkSession, sf: str) -> DataFrame:
    _, reports = _ingest(spark, sf, _odd_pages(spark, sf))
    return jobs.read_reports(spark, reports, "errors").groupBy("source", "reason").agg(
        F.count("*").alias("n"), F.sum("page_id").alias("ids")
    )


# --- logs -------------------------------------------------------------------------------


def parse_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return logs.parse_log_lines(derive.log_lines(spark, sf)).select(
        "event_id", "time", "level", F.array_join("pids", ",").alias("pids"),
        F.array_join("modules", ",").alias("modules"), "message",
        F.col("is_continuation").cast("int").alias("continued"),
    )


def log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log followed as a stream of text files, counted per level."""
    path, out = shared_dir(spark, "log"), shared_dir(spark, "parsed")
    derive.log_lines(spark, sf).select("value").write.text(path)
    (
        logs.parse_log_lines(logs.stream_log(spark, path))
        .select("level", F.length("message").alias("chars"))
        .writeStream.option("checkpointLocation", shared_dir(spark, "state"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    parsed = spark.read.schema("level string, chars int").parquet(out)
    return parsed.groupBy("level").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def _records_out(records: DataFrame) -> DataFrame:
    return records.select(
        "time", "level", F.array_join("pids", ",").alias("pids"),
        F.array_join("modules", ",").alias("modules"), "message",
        F.col("is_continuation").cast("int").alias("continued"), "lines",
    )


def log_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole records of a log in eight files, whose borders cut some."""
    path = shared_dir(spark, "log")
    lines = derive.log_lines(spark, sf).repartitionByRange(8, "event_id")
    lines.sortWithinPartitions("event_id").select("value").write.text(path)
    return _records_out(log_records_of.log_records(log_records_of.read_lines(spark, path)))


def log_records_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same log in six files that arrive one after the other, two a batch."""
    path, out = shared_dir(spark, "log"), shared_dir(spark, "records")
    lines = derive.log_lines(spark, sf)
    size = lines.agg(F.max("event_id") + 1).first()[0]
    for part in range(6):
        own = lines.filter(f"event_id * 6 div {size} = {part}").repartition(1)
        own.sortWithinPartitions("event_id").select("value").write.mode("append").text(path)
    arriving = log_records_of.stream_lines(spark, path, max_files=2)
    log_records_of.follow_records(arriving, out, shared_dir(spark, "state")).awaitTermination()
    return _records_out(log_records_of.read_records(spark, out))


LARGE = derive.LARGE_LEAGUE_PARTS
#: A strategy of the caller: the last word is the same, and the first letter.
SURNAME = matching.Strategy(
    "surname", matching.OWN, keys="array(substring_index({t}, ' ', -1))",
    holds="substring(x, 1, 1) = substring(y, 1, 1)",
)

QUERIES: dict[str, Query] = {
    "read_leagues": read_leagues,
    "read_entities": read_entities,
    "missing_dictionaries": missing_dictionaries,
    "landing_pages": landing_pages,
    "stream_pages": stream_pages,
    "unwrap_html": unwrap_html,
    "fetch_triage": fetch_triage,
    "crawl_plan": crawl_plan,
    "url_parts": url_parts,
    "script_assignment": script_assignment,
    "first_key_like": first_key_like,
    "fixture_events": fixture_events,
    "table_rows": table_rows,
    "table_results": table_results,
    "table_results_quoted": table_results_quoted,
    "parse_errors": parse_errors,
    "carry_forward": carry_forward,
    "collapse_repeats": collapse_repeats,
    "normalize_names": normalize_names,
    "exact_join": _matcher(matching.exact_join),
    "edit_join": _matcher(matching.edit_join),
    "abbrev_join": _matcher(matching.abbrev_join),
    "abbrev_join_reverse": _matcher(matching.abbrev_join, reverse=True),
    "token_join": _matcher(matching.token_join),
    "resolve_entities": _matcher(matching.resolve_entities),
    "edit_join_large": _matcher(matching.edit_join, LARGE),
    "abbrev_join_large": _matcher(matching.abbrev_join, LARGE),
    "abbrev_join_reverse_large": _matcher(matching.abbrev_join, LARGE, reverse=True),
    "token_join_large": _matcher(matching.token_join, LARGE),
    "token_join_third": _matcher(matching.token_join, threshold=0.3),
    "token_join_third_large": _matcher(matching.token_join, LARGE, threshold=0.3),
    "token_join_tenth_all_parts": _matcher(matching.token_join, derive.ALL_PARTS, threshold=0.1),
    "resolve_entities_large": _matcher(matching.resolve_entities, LARGE),
    "edit_join_k3": _matcher(matching.edit_join, k=3),
    "edit_join_k3_large": _matcher(matching.edit_join, LARGE, k=3),
    "edit_join_k4_large": _matcher(matching.edit_join, LARGE, k=4),
    "resolve_entities_own": _matcher(
        matching.resolve_entities, strategies=[*matching.DEFAULT_STRATEGIES, SURNAME]
    ),
    "resolve_entities_own_large": _matcher(
        matching.resolve_entities, LARGE,
        strategies=[matching.DEFAULT_STRATEGIES[0], SURNAME, matching.DEFAULT_STRATEGIES[1]],
    ),
    "abbrev_join_all_parts": _matcher(matching.abbrev_join, derive.ALL_PARTS, key_names=100),
    "abbrev_join_reverse_all_parts": _matcher(matching.abbrev_join, derive.ALL_PARTS, reverse=True, key_names=100),
    "resolve_entities_strict": _matcher(matching.resolve_entities, strict=True),
    "split_matchups": split_matchups,
    "resolve_matchups": resolve_matchups,
    "match_batch": match_batch,
    "unmatched": unmatched,
    "attach_canonical": attach_canonical,
    "match_report": match_report,
    "unmatched_names": unmatched_names,
    "league_lookup": league_lookup,
    "consolidate_scores": consolidate_scores,
    "consolidate_scores_stream": consolidate_stream,
    "upsert_events": upsert_events,
    "events_for_league": events_for_league,
    "all_events": all_events,
    "count_by_league": count_by_league,
    "purge_events": purge_events,
    "league_feed": league_feed,
    "league_feed_files": league_feed_files,
    "pages_to_events": pages_to_events,
    "ingest_stream": ingest_stream,
    "ingest_unmatched": ingest_unmatched,
    "ingest_errors": ingest_errors,
    "ingest_report": ingest_report,
    "ingest_changed_dictionary": ingest_changed_dictionary,
    "ingest_counts": ingest_counts,
    "parse_log_lines": parse_log_lines,
    "log_stream": log_stream,
    "log_records": log_records,
    "log_records_stream": log_records_stream,
}
