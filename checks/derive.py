"""Operator inputs derived from the given tables.

Pages, dictionaries and result rows are made by Spark from whole tables, in blocks of
fixed size, so that they grow with the tables while each page and league stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAGUE_PARTS = 50
LARGE_LEAGUE_PARTS = 1000
ALL_PARTS = 1_000_000_000  # one league holds every part
PAGE_ORDERS = 40
NOON = 1735732800  # 2025-01-01 12:00 UTC


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def in_tasks(df: DataFrame) -> DataFrame:
    """Rows of a small single-file table, spread over all tasks; large tables as they are."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def looked_up(names: DataFrame) -> DataFrame:
    """Names that rows are joined with by part: as many as parts, so never sent to the driver."""
    return names.hint("shuffle_hash")


def by_page(df: DataFrame) -> DataFrame:
    """Spread rows over as many tasks as a landing table would have files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")


# --- dictionary and free-text names from part and lineitem ----------------------------


def entity_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, value) of one JSON dictionary per block of parts; every 7th is cut short."""
    part = table(spark, sf, "part").selectExpr(
        f"p_partkey div {LEAGUE_PARTS} as block", "p_partkey", "p_name",
        "case when p_size % 10 = 0 then array(p_brand || ' ' || p_type, p_type || ' & ' || p_brand)"
        " when p_size % 3 = 0 then array(p_brand || ' ' || p_type) end as others",
    )
    return part.groupBy("block").agg(
        F.expr(
            "to_json(transform(array_sort(collect_list(struct(p_partkey, p_name, others))),"
            " p -> named_struct('name', p.p_name, 'altNames', p.others)))"
        ).alias("json")
    ).selectExpr(
        "'/teams/L' || block || '.json' as path",
        "if(block % 7 = 6, substring(json, 2), json) as value",
    )


def leagues(spark: SparkSession, sf: str) -> DataFrame:
    """The leagues of ``entity_files``, plus some without a file."""
    blocks = table(spark, sf, "part").selectExpr(f"p_partkey div {LEAGUE_PARTS} as block").distinct()
    return blocks.selectExpr("inline(array(struct('L' || block as code), struct('M' || block as code)))")


def part_names(spark: SparkSession, sf: str, size: int = LEAGUE_PARTS) -> DataFrame:
    """Dictionary name of each part; large leagues add the brand to keep names apart."""
    name = "p_name" if size == LEAGUE_PARTS else "p_name || ' ' || p_brand"
    return table(spark, sf, "part").selectExpr(
        "p_partkey", f"'L' || p_partkey div {size} as league",
        f"int(p_partkey % {size}) as entity_pos", f"{name} as entity", "p_brand", "p_type",
        "p_size",
    )


def aliases(spark: SparkSession, sf: str, size: int = LEAGUE_PARTS) -> DataFrame:
    from touchline.functions.text import normalized

    return part_names(spark, sf, size).selectExpr(
        "league", "entity_pos", "entity",
        """posexplode(concat(array(entity), case
            when p_size % 10 = 0 then array(p_brand || ' ' || p_type, p_type || ' & ' || p_brand)
            when p_size % 3 = 0 then array(p_brand || ' ' || p_type)
            else array() end)) as (alias_pos, alias)""",
    ).withColumn("alias_norm", normalized(F.col("alias")))


def spoiled(name: str, key: str) -> str:
    """SQL that spoils a name in one of ten ways; valid in Spark and DuckDB."""
    return f"""case
        when ({key}) % 97 = 0 then '2025'
        when ({key}) % 9 = 0 then {name}
        when ({key}) % 9 = 1 then upper({name})
        when ({key}) % 9 = 2 then concat(substring({name}, 1, 2), substring({name}, 4, length({name})))
        when ({key}) % 9 = 3 then concat(substring({name}, 1, 1), ' ', split_part({name}, ' ', 2))
        when ({key}) % 9 = 4 then concat({name}, ' Town')
        when ({key}) % 9 = 5 then split_part({name}, ' ', 2)
        when ({key}) % 9 = 6 then concat('Real ', {name}, '  2025')
        when ({key}) % 9 = 7 then replace({name}, ' ', '-. ')
        else concat('Zz', ({key}) % 7) end"""


def entity_texts(spark: SparkSession, sf: str, size: int = LEAGUE_PARTS) -> DataFrame:
    """(league, text) of each line item: its part's name, spoiled."""
    line = in_tasks(table(spark, sf, "lineitem")).selectExpr(
        "l_partkey as p_partkey", "l_orderkey + l_linenumber * 3 as k"
    )
    return line.join(looked_up(part_names(spark, sf, size)), "p_partkey").selectExpr(
        "league", f"{spoiled('entity', 'k')} as text"
    )


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows: each line item's part against another part of the same league.

    Staged, as queries read them once for the names and once for the rows.
    """
    from touchline.session import staged

    names = part_names(spark, sf)
    line = in_tasks(table(spark, sf, "lineitem")).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey as home_key",
        f"(l_partkey div {LEAGUE_PARTS}) * {LEAGUE_PARTS} + (l_suppkey + l_linenumber)"
        f" % {LEAGUE_PARTS} as away_key",
        "int(l_quantity) as goals", "l_shipdate",
    )
    home = names.selectExpr("p_partkey as home_key", "league", "entity as home")
    away = names.selectExpr("p_partkey as away_key", "entity as away")
    rows = (
        line.join(looked_up(home), "home_key").join(looked_up(away), "away_key")
        .selectExpr(
            f"(home_key div {LEAGUE_PARTS}) * 16 + l_orderkey % 16 as page_id",
            "if(l_orderkey % 2 = 0, 'bbc', 'fishy') as source",
            "league",
            "l_orderkey * 8 + l_linenumber as pos",
            "string(to_date(l_shipdate)) as date",
            f"""concat({spoiled('home', 'l_orderkey + l_linenumber * 3')},
                case l_orderkey % 5 when 0 then ' v ' when 1 then ' VS ' when 2 then ' vs. '
                else ' vs ' end,
                {spoiled('away', 'l_orderkey * 2 + l_linenumber')}) as name""",
            "concat(goals % 5, '-', l_linenumber) as score",
            f"timestamp_seconds({NOON} + (l_orderkey % 16) * 60) as fetched_at",
        )
    )
    return staged(rows, "fixtures")


# --- pages ------------------------------------------------------------------------------

_SCRIPT = """concat('<html><head><script>var x = "<p>";</script><script>window.__INITIAL_DATA__=',
    if({quoted}, concat('"', replace(replace({json}, r'\\', r'\\\\'), '"', r'\\"'), '"'), {json}),
    ';</script></head><body>none</body></html>')"""


def script_html(json: str, quoted: str) -> str:
    return _SCRIPT.format(json=json, quoted=quoted)


def envelope(groups: str) -> str:
    return (
        f"""concat('{{"data":{{"menu":[1],"sport-data-scores-fixtures?d=1":"""
        f"""{{"data":{{"eventGroups":[', {groups}, ']}}}},"z":{{}}}}}}')"""
    )


def fixture_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``fixtures`` as pages of both sites."""
    rows = fixtures(spark, sf)
    event = """to_json(named_struct('status', 'PostEvent',
        'home', named_struct('fullName', parts[0], 'score', split_part(score, '-', 1)),
        'away', named_struct('fullName', parts[1], 'score', split_part(score, '-', 2)),
        'date', named_struct('isoDate', date || 'T15:00:00Z')))"""
    row = """concat('<tr class="success"><th>', date_format(to_date(date), 'EEE dd-MMM-yyyy'),
        '</th></tr><tr class="cats"><td><a class="cats" href="#">',
        replace(parts[0], '&', '&amp;'), '</a></td><td class="catsc"><a>', score,
        '</a></td><td><a class="cats" href="#">', replace(parts[1], '&', '&amp;'),
        '</a></td></tr>')"""
    pages = (
        by_page(rows).selectExpr("*", "split(name, '(?i) vs?[.]? ') as parts")
        .selectExpr(
            "page_id", "source", "league", "fetched_at",
            f"struct(pos, if(source = 'bbc', {event}, {row}) as item) as item",
        )
        .groupBy("page_id", "source", "league", "fetched_at")
        .agg(F.expr("transform(array_sort(collect_list(item)), i -> i.item) as items"))
    )
    groups = """'{"secondaryGroups":[{"events":[', array_join(items, ','), ']}]}'"""
    return pages.selectExpr(
        "page_id", "source", "league", "concat('https://example.com/', page_id) as url",
        "200 as status",
        f"""if(source = 'bbc', {script_html(envelope(groups), 'page_id % 4 = 0')},
            concat('<table class="table table-results">', array_join(items, ''), '</table>'))
            as body""",
        "fetched_at",
    )


def order_script_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as script pages: one event group per priority, some fields missing or odd."""
    event = """to_json(named_struct(
        'status', case o_orderstatus when 'F' then 'PostEvent' else 'PreEvent' end,
        'home', named_struct(
            'fullName', case when o_orderkey % 7 = 0 then '' when o_orderkey % 11 = 0 then null
                        else concat('Customer "', o_custkey, r'" \\ é') end,
            'shortName', if(o_orderkey % 3 = 0, null, concat('C', o_custkey)),
            'score', if(o_orderkey % 5 = 0, null, o_custkey % 10)),
        'away', named_struct('fullName', concat('Clerk ', o_custkey % 100),
                             'score', string(o_orderkey % 4)),
        'date', named_struct('isoDate', if(o_orderkey % 13 = 0, null,
                             concat(string(to_date(o_orderdate)), 'T15:00:00Z')))))"""
    orders = table(spark, sf, "orders").selectExpr(
        f"o_orderkey div {PAGE_ORDERS} as page_id", "o_orderpriority",
        f"struct(o_orderkey, if(o_orderkey % 29 = 0, replace({event}, '\"home\":', '\"home\":1,\"h\":'),"
        f" {event}) as item) as item",
    )
    by_priority = by_page(orders).groupBy("page_id", "o_orderpriority").agg(
        F.expr(
            "array_join(transform(array_sort(collect_list(item)), i -> i.item), ',') as events"
        )
    )
    pages = by_priority.groupBy("page_id").agg(
        F.expr(
            """array_join(transform(array_sort(collect_list(struct(o_orderpriority, events))),
                g -> concat('{"name":"x","secondaryGroups":[{"events":[', g.events, ']},{}]}')), ',')
               as groups"""
        )
    )
    return _raw(pages, "bbc", script_html(envelope("groups"), "page_id % 2 = 1"))


def order_table_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as table pages: a header row now and then, some without a usable date.

    Some rows lack an end tag, hold a table of their own or spell a letter as a number with
    leading zeros; a comment before the table looks like one.
    """
    item = """concat(
        case when o_orderkey % 4 <> 0 then ''
             when o_orderkey % 24 = 0 then '<tr class="success"><th>Sun 31-Foo-2025</th></tr>'
             when o_orderkey % 40 = 4 then '<tr class="success"><th> </th></tr>'
             else concat('<TR class=success id=a><th>', date_format(o_orderdate, 'EEE dd-MMM-yyyy'),
                         '</th></TR>') end,
        '<tr class="', if(o_orderkey % 19 = 0, 'cats odd', 'cats'),
        '"><td><a class="cats" href="/t">', if(o_orderkey % 9 = 2, '&#00000084;om', 'Tom'),
        ' &amp; <b>Co</b>  ', o_custkey % 3, '</a></td>',
        '<td class="num catsc"><a href="/s">', case when o_orderkey % 6 = 0 then ' 3–1 '
            when o_orderkey % 10 = 5 then 'P-P' when o_orderkey % 14 = 3 then ''
            else concat(o_custkey % 2, '-', o_custkey % 4) end,
        '</a></td><td><a href="/u" class="cats">Clerk&#39;s ', o_custkey % 5, '</a>',
        if(o_orderkey % 8 = 3, '<table><tr class="odd"><td>1</td></tr></table>', ''),
        if(o_orderkey % 5 = 1, '', '</td></tr>'))"""
    orders = table(spark, sf, "orders").selectExpr(
        f"o_orderkey div {PAGE_ORDERS} as page_id", f"struct(o_orderkey, {item} as item) as item"
    )
    pages = by_page(orders).groupBy("page_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(item)), i -> i.item), '') as rows")
    )
    return _raw(
        pages, "fishy",
        "concat('<p>x</p><!-- <table class=\"table-results\"></table> --><table class=\"a table-results\">', rows, '</table><table></table>')",
    )


def _raw(pages: DataFrame, source: str, body: str) -> DataFrame:
    return pages.selectExpr(
        "page_id", f"'{source}' as source", "'L' || page_id % 5 as league",
        "concat('https://example.com/', page_id) as url", "200 as status", f"{body} as body",
        f"timestamp_seconds({NOON} + page_id % 1000) as fetched_at",
    )


def fetched_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The given web pages as fetched pages with a status each."""
    return table(spark, sf, "pages").selectExpr(
        "page_id", "if(page_id % 3 = 0, 'fishy', 'bbc') as source",
        "'L' || page_id % 5 as league", "url",
        "case when page_id % 10 = 7 then 404 when page_id % 10 = 9 then null else 200 end as status",
        "html as body", f"timestamp_seconds({NOON} + page_id % 1000) as fetched_at",
    )


# --- resolved results from events -------------------------------------------------------


def event_results(spark: SparkSession, sf: str) -> DataFrame:
    """User events as result rows of two sources."""
    return table(spark, sf, "events").selectExpr(
        "event_id div 10 as page_id",
        "if(event_id % 2 = 0, 'bbc', 'fishy') as source",
        "event_type as league",
        "int(event_id % 10) as pos",
        "string(to_date(ts)) as date",
        "concat('User ', user_id) as name",
        "concat(int(floor(value)), '-', event_id % 5) as score",
        "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"
        " as fetched_at",
    )


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of an application log."""
    return table(spark, sf, "events").selectExpr(
        "event_id",
        """case when event_id % 11 = 0 then concat('    at ', props)
            when event_id % 17 = 0 then concat('2024 ', event_type)
            else concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+00:00 [',
                case event_type when 'error' then 'error' when 'view' then 'DEBUG'
                    when 'signup' then 'warning' when 'click' then 'info' else 'notice' end,
                '] ', case event_id % 3 when 0 then 'scheduler' when 1 then 'bbc_pool' else 'x' end,
                ' <0.', user_id, '.0>: value ', value) end as value""",
    )
