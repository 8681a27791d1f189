"""The expected answer of each query as SQL on the given tables."""

from __future__ import annotations

from checks import derive

N, LARGE, P, NOON = (
    derive.LEAGUE_PARTS, derive.LARGE_LEAGUE_PARTS, derive.PAGE_ORDERS, derive.NOON,
)


def _names(size: int = N) -> str:
    name = "p_name" if size == N else "p_name || ' ' || p_brand"
    return f"""names as (
        select p_partkey, 'L' || p_partkey // {size} as league, p_partkey % {size} as entity_pos,
               {name} as entity, p_brand, p_type, p_size from part)"""


_OTHERS = """case when p_size % 10 = 0 then [p_brand || ' ' || p_type, p_type || ' & ' || p_brand]
    when p_size % 3 = 0 then [p_brand || ' ' || p_type] else [] end"""


def _norm(text: str) -> str:
    return f"""lower(array_to_string(list_filter(
        string_split_regex(translate({text}, '''-.,:;()/', ''), '\\s+'),
        lambda t: t <> '' and t <> 'Real' and not regexp_full_match(t, '[0-9]+')), ' '))"""


def _aliases(size: int = N) -> str:
    return f"""{_names(size)},
    aliases as (
        select league, entity_pos, i - 1 as alias_pos, entity, all_names[i] as alias,
               {_norm('all_names[i]')} as y
        from (select *, list_concat([entity], {_OTHERS}) as all_names from names),
             unnest(range(1, len(all_names) + 1)) as u(i))"""


def _texts(size: int = N) -> str:
    return f"""texts as (
        select distinct league, {derive.spoiled('entity', 'l_orderkey + l_linenumber * 3')} as text
        from lineitem join names on l_partkey = p_partkey)"""


_PATTERN = """'^' || array_to_string(list_transform(string_split({0}, ''),
    lambda c: regexp_escape(c)), '[^ ]* ?')"""


def _abbreviates(short: str, long: str) -> str:
    pattern = _PATTERN.format(short)
    return (
        f"({short} = '' or (left({short}, 1) = left({long}, 1)"
        f" and regexp_matches({long}, {pattern})))"
    )


_RULES = {
    "exact": "x = y",
    "edit": "levenshtein(x, y) <= 2",
    "abbrev0": _abbreviates("x", "y"),
    "abbrev1": _abbreviates("y", "x"),
    "token": """x <> '' and y <> '' and 2 * list_sum(list_transform(string_split(x, ' '),
        lambda t: len(list_filter(string_split(y, ' '), lambda u: u = t))))
        >= len(string_split(x, ' ')) * len(string_split(y, ' '))""",
}


for _k in (3, 4):
    _RULES[f"edit{_k}"] = f"levenshtein(x, y) <= {_k}"
_RULES["surname"] = "string_split(x, ' ')[-1] = string_split(y, ' ')[-1] and left(x, 1) = left(y, 1)"
for _name, _least in (("token_third", 0.3), ("token_tenth", 0.1)):
    _RULES[_name] = f"""x <> '' and y <> '' and list_sum(list_transform(string_split(x, ' '),
        lambda t: len(list_filter(string_split(y, ' '), lambda u: u = t))))
        / (len(string_split(x, ' ')) * len(string_split(y, ' ')))::double >= {_least}::double"""
_LABELS = {"edit3": "edit", "edit4": "edit", "token_third": "token", "token_tenth": "token"}


def _best(rules: list[str], strict: bool = False) -> str:
    """Needs keyed(league, x) and aliases; the first hit of every text by brute force."""
    cases = " ".join(f"when {_RULES[r]} then {i}" for i, r in enumerate(rules))
    labels = " ".join(f"when {i} then '{_LABELS.get(r, r)}'" for i, r in enumerate(rules))
    given = "where x <> '' and y <> ''" if strict else ""
    return f"""dictionary as (
        select league, y, arg_min(entity, (entity_pos, alias_pos)) as entity,
               min((entity_pos, alias_pos)) as place from aliases group by all),
    pairs as (
        select k.league, x, entity, place, case {cases} end as rank
        from keyed k join dictionary d on k.league = d.league {given}),
    best as (
        select league, x, arg_min(entity, (rank, place)) as entity,
               case min(rank) {labels} end as strategy
        from pairs where rank is not null group by league, x)"""


def _resolve(rules: list[str], size: int = N, strict: bool = False) -> str:
    return f"""with {_aliases(size)}, {_texts(size)},
    normed as (select league, text, {_norm('text')} as x from texts),
    keyed as (select distinct league, x from normed),
    {_best(rules, strict)}
    select n.league, n.text, b.entity, b.strategy
    from normed n left join best b on n.league = b.league and n.x = b.x"""


_ALL = ["exact", "edit", "abbrev0", "abbrev1", "token"]

_FIXTURES = f"""lines as (
        select l_orderkey, l_linenumber, l_partkey as home_key,
               (l_partkey // {N}) * {N} + (l_suppkey + l_linenumber) % {N} as away_key,
               l_quantity::int as goals, l_shipdate from lineitem),
    fixtures as (
        select (home_key // {N}) * 16 + l_orderkey % 16 as page_id,
               case when l_orderkey % 2 = 0 then 'bbc' else 'fishy' end as source, h.league,
               l_orderkey * 8 + l_linenumber as pos, l_shipdate::date::varchar as date,
               {derive.spoiled('h.entity', 'l_orderkey + l_linenumber * 3')} as home_text,
               {derive.spoiled('a.entity', 'l_orderkey * 2 + l_linenumber')} as away_text,
               concat(home_text, case l_orderkey % 5 when 0 then ' v ' when 1 then ' VS '
                   when 2 then ' vs. ' else ' vs ' end, away_text) as name,
               concat(goals % 5, '-', l_linenumber) as score,
               ({NOON} + (l_orderkey % 16) * 60) * 1000 as fetched_ms
        from lines join names h on home_key = h.p_partkey join names a on away_key = a.p_partkey)"""

_SPLIT = r"(?i)\s+vs?\s+"


def _matchups(rows: str, rules: list[str] = _ALL) -> str:
    """Needs the named rows; adds resolved(league, name, canonical)."""
    return f"""split as (
        select league, name, {_norm('parts[1]')} as home, {_norm('parts[2]')} as away
        from (select distinct league, name, string_split_regex(name, '{_SPLIT}') as parts
              from {rows}) where len(parts) = 2),
    keyed as (select league, home as x from split union select league, away from split),
    {_best(rules)},
    resolved as (
        select s.league, s.name, h.entity || ' vs ' || a.entity as canonical
        from split s join best h on s.league = h.league and s.home = h.x
             join best a on s.league = a.league and s.away = a.x
        where h.entity <> a.entity)"""


_MATCHED = f"with {_aliases()}, {_FIXTURES}, {_matchups('fixtures')}"
_ANNOTATED = f"""{_MATCHED},
    annotated as (
        select f.*, r.canonical from fixtures f
        left join resolved r on f.league = r.league and f.name = r.name)"""

_EVENT_RESULTS = """results as (
        select event_id // 10 as page_id, event_id % 10 as pos,
               case when event_id % 2 = 0 then 'bbc' else 'fishy' end as source,
               event_type as league, ts::date::varchar as date, 'User ' || user_id as name,
               concat(floor(value)::int, '-', event_id % 5) as score,
               epoch_us(ts) as arrived from events)"""


def _consolidate(rows: str, arrived: str, to_ms: str) -> str:
    return f"""consolidated as (
        select league, name, date,
               arg_max(score, ({arrived}, page_id, pos)) filter (source = 'bbc') as bbc_score,
               arg_max(score, ({arrived}, page_id, pos)) filter (source = 'fishy') as fishy_score,
               min({arrived}) {to_ms} as created_ms, max({arrived}) {to_ms} as updated_ms
        from {rows} group by league, name, date)"""


_EVENTS = f"with {_EVENT_RESULTS}, {_consolidate('results', 'arrived', '// 1000')}"

_SCRIPT_EVENTS = f"""script_events as (
        select o_orderkey // {P} as page_id,
               row_number() over (partition by o_orderkey // {P}
                                  order by o_orderpriority, o_orderkey) - 1 as pos,
               o_orderkey % 29 = 0 as bad,
               case when o_orderkey % 13 = 0 then
                   make_timestamp(({NOON} + (o_orderkey // {P}) % 1000) * 1000000)::date::varchar
                   else o_orderdate::date::varchar end as date,
               case when o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0
                        then concat('Customer "', o_custkey, '" \\ é')
                    when o_orderkey % 3 <> 0 then concat('C', o_custkey) else 'Unknown' end
                   || ' vs Clerk ' || o_custkey % 100 as name,
               concat(case when o_orderkey % 5 = 0 then 0 else o_custkey % 10 end, '-',
                      o_orderkey % 4) as score
        from orders where o_orderstatus = 'F')"""

_TABLE_ROWS = f"""table_orders as (
        select *, o_orderkey // {P} as page_id,
               case when o_orderkey % 4 <> 0 or (o_orderkey % 40 = 4 and o_orderkey % 24 <> 0) then null
                    when o_orderkey % 24 = 0 then {{'d': null::date}}
                    else {{'d': o_orderdate::date}} end as head from orders),
    carried as (
        select *, (last_value(head ignore nulls) over (
            partition by page_id order by o_orderkey
            rows between unbounded preceding and current row)).d as day from table_orders),
    table_found as (
        select page_id, min(day)::varchar as date, min(o_orderkey) as seen, name, score from (
            select *, 'Tom & Co ' || o_custkey % 3 || ' vs Clerk''s ' || o_custkey % 5 as name,
                case when o_orderkey % 6 = 0 then '3-1' when o_orderkey % 10 = 5 then '-'
                     when o_orderkey % 14 = 3 then ''
                     else concat(o_custkey % 2, '-', o_custkey % 4) end as score
            from carried where day is not null and o_orderkey % 19 <> 0)
        where score <> '' group by page_id, name, score)"""

_LEAGUES = f"""leagues as (
        select distinct c || p_partkey // {N} as league
        from part, (values ('L'), ('M')) v(c) where p_partkey % {N} = 0)"""

_CUSTOMER_LEAGUES = """select c_name, c_custkey,
    case when c_nationkey % 4 = 0 then null else lower(c_mktsegment) end as bbc,
    case when c_nationkey % 5 = 0 then null else c_nationkey end as fishy from customer"""


def _crawl(source: str, ident: str, url: str) -> str:
    return f"""select '{source}' as source, c_name as league, k::int as cycle,
        3000 + c_custkey * 10000 + k * 60000 as due_ms, 60000::bigint as interval_ms, {url} as url
        from ({_CUSTOMER_LEAGUES}), range(3) r(k) where {ident} is not null"""


_URL = """select page_id, case page_id % 9 when 5 then substr(url, strpos(url, '://') + 3)
    when 6 then replace(url, '.example.', '.example:8080/') when 7 then 'ftp' || url
    else url end as url from pages"""


_LOG = """select event_id, event_id % 11 = 0 or event_id % 17 = 0 as continued,
    case event_type when 'error' then 'error' when 'view' then 'DEBUG' when 'signup' then 'warning'
        when 'click' then 'info' else 'notice' end as lv,
    case event_id % 3 when 0 then 'scheduler' when 1 then 'bbc_pool' else 'x' end as md,
    case when event_id % 11 = 0 then '    at ' || props when event_id % 17 = 0
        then '2024 ' || event_type
        else concat(md, ' <0.', user_id, '.0>: value ', value) end as message,
    user_id, ts, case when lv in ('info', 'error', 'warning') then lv
        when lv = 'DEBUG' then 'debug' end as level from events"""

ORACLE: dict[str, str] = {
    "read_leagues": """select c_name as code,
        case when c_nationkey % 4 = 0 then null else lower(c_mktsegment) end as "bbcName",
        c_nationkey as "thefishyId", 1 as rounds, (c_acctbal > 0)::int as active,
        (row_number() over (partition by c_custkey // 100 order by c_custkey) - 1)::int as league_idx
        from customer""",
    "read_entities": f"""with {_aliases()}
        select league, entity_pos::int as entity_pos, alias_pos::int as alias_pos, entity, alias,
               y as alias_norm
        from aliases where substr(league, 2)::int % 7 <> 6""",
    "missing_dictionaries": f"""with {_LEAGUES}
        select league, case when league like 'M%' then 'file missing' else 'not decodable' end
               as reason
        from leagues where league like 'M%' or substr(league, 2)::int % 7 = 6""",
    "landing_pages": """select case when page_id % 3 = 0 then 'fishy' else 'bbc' end as source,
        'L' || page_id % 5 as league, count(*) as pages, sum(length(html))::bigint as chars,
        sum(page_id)::bigint as ids from pages group by all""",
    "stream_pages": """select page_id, case when page_id % 3 = 0 then 'fishy' else 'bbc' end
        as source, 'L' || page_id % 5 as league,
        case when page_id % 10 = 7 then 404 when page_id % 10 = 9 then null else 200 end as status,
        length(html)::int as chars from pages""",
    "unwrap_html": "select page_id, md5(html) as digest from pages where page_id % 5 < 3",
    "fetch_triage": """select page_id, case page_id % 10 when 7 then 'http_status'
        when 9 then 'transport' else 'ok' end as route, case page_id % 10 when 7 then 'status 404'
        when 9 then 'no response' else '' end as reason from pages""",
    "crawl_plan": _crawl(
        "bbc", "bbc",
        "'https://www.bbc.co.uk/sport/football/' || bbc || '/scores-fixtures/2025-03?filter=results'",
    ) + " union all " + _crawl(
        "fishy", "fishy", "'https://thefishy.co.uk/football-results.php?table=' || fishy"
    ),
    "url_parts": f"""select page_id, url,
        nullif(regexp_extract(url, '^(https?)://', 1), '') as scheme,
        nullif(regexp_extract(url, '^https?://([^/:#]*)', 1), '') as host,
        case when url like 'http%' then coalesce(
            try_cast(nullif(regexp_extract(url, '^https?://[^/:]*:([0-9]+)', 1), '') as int),
            case when url like 'https%' then 443 else 80 end) end as port,
        case when url like 'http%' then
            '/' || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) end as path,
        case when url like 'http%' then regexp_extract(url, '\\?([^#]*)', 1) end as query,
        case when url like 'http%' then regexp_extract(url, '#(.*)$', 1) end as fragment,
        case when url like 'ftp%' then 'unknown scheme' when url not like '%://%' then 'no scheme'
            end as url_error
        from ({_URL})""",
    "script_assignment": """select page_id, regexp_replace(trim(regexp_extract(
        regexp_extract(html, '(?is)<script\\b[^>]*>([^<]*var t.*?)</script>', 1),
        '(?s)var t[^=]*=(.*)$', 1)), ';$', '') as value from pages""",
    "first_key_like": """select event_id, case when event_type in ('click', 'signup', 'view')
        then event_type || '-' || user_id else 'signup-0' end as first_key from events""",
    "fixture_events": f"""with {_SCRIPT_EVENTS}
        select page_id, pos::int as pos, date, name, score from script_events where not bad""",
    "table_rows": f"""with r as (
        select o_orderkey // {P} as page_id, 'success' as css_class, o_orderkey, 0 as k,
            case when o_orderkey % 24 = 0 then '<th>Sun 31-Foo-2025</th>'
                 when o_orderkey % 40 = 4 then '<th> </th>'
                 else '<th>' || strftime(o_orderdate, '%a %d-%b-%Y') || '</th>' end as content
        from orders where o_orderkey % 4 = 0 union all
        select o_orderkey // {P}, case when o_orderkey % 19 = 0 then 'cats odd' else 'cats' end,
            o_orderkey, 1, concat('<td><a class="cats" href="/t">',
            case when o_orderkey % 9 = 2 then '&#00000084;om' else 'Tom' end, ' &amp; <b>Co</b>  ',
            o_custkey % 3, '</a></td><td class="num catsc"><a href="/s">',
            case when o_orderkey % 6 = 0 then ' 3–1 ' when o_orderkey % 10 = 5 then 'P-P'
                 when o_orderkey % 14 = 3 then '' else concat(o_custkey % 2, '-', o_custkey % 4) end,
            '</a></td><td><a href="/u" class="cats">Clerk&#39;s ', o_custkey % 5, '</a>',
            case when o_orderkey % 5 <> 1 then '</td>' else '' end) from orders)
        select page_id, (row_number() over (partition by page_id order by o_orderkey, k) - 1)::int as pos,
               css_class, md5(content) as digest from r""",
    "table_results": f"""with {_TABLE_ROWS}
        select page_id, (row_number() over (partition by page_id order by date, name, seen)
               - 1)::int as pos, date, name, score from table_found""",
    "parse_errors": f"""with {_SCRIPT_EVENTS}
        select source, reason, count(*) as n, sum(page_id)::bigint as ids from (
            select 'bbc' as source, 'event home is no object' as reason, page_id
            from script_events where bad union all
            select case when page_id % 20 = 8 then 'other' when page_id % 20 = 4 then null
                     when page_id % 3 = 0 then 'fishy' else 'bbc' end,
                case when page_id % 10 = 7 then 'status 404' when page_id % 10 = 9 then 'no response'
                     when page_id % 20 in (4, 8) then 'unknown source'
                     when page_id % 3 = 0 then 'results table not found'
                     else 'no script with the marker' end, page_id from pages)
        group by all""",
    "carry_forward": """select event_id, user_id, (last_value(
            case when event_type = 'signup'
                 then {'v': case when value >= 2 then value end} end ignore nulls) over (
            partition by user_id order by event_id
            rows between unbounded preceding and current row)).v as current
        from (select * replace (case when user_id % 50 <> 0 then user_id end as user_id) from events)""",
    "collapse_repeats": """select l_partkey, l_quantity::int as quantity,
        min(l_shipdate)::date::varchar as date from lineitem group by all""",
    "normalize_names": f"select doc_id, {_norm('text')} as norm from documents",
    "exact_join": _resolve(["exact"]),
    "edit_join": _resolve(["edit"]),
    "abbrev_join": _resolve(["abbrev0"]),
    "abbrev_join_reverse": _resolve(["abbrev1"]),
    "token_join": _resolve(["token"]),
    "resolve_entities": _resolve(_ALL),
    "edit_join_large": _resolve(["edit"], LARGE),
    "abbrev_join_large": _resolve(["abbrev0"], LARGE),
    "abbrev_join_reverse_large": _resolve(["abbrev1"], LARGE),
    "token_join_large": _resolve(["token"], LARGE),
    "token_join_third": _resolve(["token_third"]),
    "token_join_third_large": _resolve(["token_third"], LARGE),
    "token_join_tenth_all_parts": _resolve(["token_tenth"], derive.ALL_PARTS),
    "resolve_entities_large": _resolve(_ALL, LARGE),
    "abbrev_join_all_parts": _resolve(["abbrev0"], derive.ALL_PARTS),
    "abbrev_join_reverse_all_parts": _resolve(["abbrev1"], derive.ALL_PARTS),
    "edit_join_k3": _resolve(["edit3"]),
    "edit_join_k3_large": _resolve(["edit3"], LARGE),
    "edit_join_k4_large": _resolve(["edit4"], LARGE),
    "resolve_entities_own": _resolve([*_ALL, "surname"]),
    "resolve_entities_own_large": _resolve(["exact", "surname", "edit"], LARGE),
    "resolve_entities_strict": _resolve(_ALL, strict=True),
    "split_matchups": f"""with {_names()}, {_FIXTURES}
        select page_id, pos, case when len(parts) = 2 then parts[1] end as home,
               case when len(parts) = 2 then parts[2] end as away
        from (select *, string_split_regex(name, '{_SPLIT}') as parts from fixtures)""",
    "resolve_matchups": f"""{_ANNOTATED}
        select page_id, source, league, pos, date, canonical as name, score
        from annotated where canonical is not null""",
    "match_batch": f"{_MATCHED} select league, name, canonical from resolved",
    "unmatched": f"""{_ANNOTATED}
        select page_id, league, pos, name from annotated where canonical is null""",
    "attach_canonical": f"""{_MATCHED}
        select page_id, pos, f.league, canonical as name, score
        from fixtures f join resolved r on f.league = r.league and f.name = r.name""",
    "match_report": f"""{_ANNOTATED}
        select source, league, count(*) as parsed,
               count(distinct case when canonical is not null then name end) as matched,
               count(*) filter (canonical is null) as unmatched_rows,
               count(distinct case when canonical is null then name end) as unmatched_names,
               null::varchar as name, null::bigint as rows
        from annotated group by source, league
        union all select source, league, null, null, null, null, name, count(*)
        from annotated where canonical is null group by source, league, name""",
    "unmatched_names": f"""{_ANNOTATED}
        select source, league, name, count(*) as rows from annotated where canonical is null
        group by all""",
    "league_lookup": f"""with {_aliases()},
        leagues as (select 'L' || (p_partkey * 7 % (p_partkey // {N} + 1)) as code,
                           arg_max(p_brand, p_partkey) as brand from part group by 1),
        codes as (select distinct 'L' || (p_partkey // {N * 2}) * 3 as code from part)
        select c.code, l.code is not null as found, l.brand as "bbcName",
               a.entity_pos::int as entity_pos, a.entity
        from codes c left join leagues l on c.code = l.code
        left join (select * from aliases where alias_pos = 0) a on c.code = a.league""",
    "consolidate_scores": f"{_EVENTS} select * from consolidated",
    "consolidate_scores_stream": f"{_EVENTS} select * from consolidated",
    "upsert_events": f"{_EVENTS} select * from consolidated",
    "all_events": f"{_EVENTS} select * from consolidated",
    "purge_events": f"""{_EVENTS} select * from consolidated
        where date >= (select (max(ts::date) - 10)::varchar from events)""",
    "events_for_league": f"{_EVENTS} select * from consolidated where league = 'purchase'",
    "count_by_league": f"""{_EVENTS} select league, count(*) as "count"
        from consolidated group by league""",
    "league_feed": f"""{_EVENTS}, codes as (
        select distinct case when event_id % 50 = 0 then 'none-' || user_id % 7
            when event_type <> 'view' then event_type end as league from events),
        wanted as (select c.league, count(e.name) as n
                   from codes c left join consolidated e on c.league = e.league
                   where c.league is not null group by c.league)
        select league, 0 as part, null as date, null as name,
               concat('{{"league":"', league, '","count":', n, ',"events":[') as line from wanted
        union all select league, 2, null, null, ']}}' from wanted
        union all select league, 1, date, name,
            case when row_number() over (partition by league order by date, name) = 1 then ''
                 else ',' end || concat('{{"league":"', league, '","name":"', name, '","date":"',
            date, '"', ',"bbc_score":"' || bbc_score || '"', ',"fishy_score":"' || fishy_score || '"',
            ',"created_at":', created_ms, ',"updated_at":', updated_ms, '}}') as line
        from consolidated where league in (select league from wanted)""",
    "league_feed_files": f"""{_EVENTS}, e as (
        select * replace (case when league = 'view' then '' else league end as league) from consolidated),
        wanted as (select c.league, count(e.name) as n from (
            select distinct case when event_type = 'view' then '' when event_id % 50 = 0 then 'none/1'
                else event_type end as league from events) c
            left join e on c.league = e.league group by c.league)
        select league, concat('{{"league":"', league, '","count":', n, ',"events":[') as "value" from wanted
        union all select league, ']}}' from wanted
        union all select league,
            case when row_number() over (partition by league order by date, name) = 1 then ''
                 else ',' end || concat('{{"league":"', league, '","name":"', name, '","date":"',
            date, '"', ',"bbc_score":"' || bbc_score || '"', ',"fishy_score":"' || fishy_score || '"',
            ',"created_at":', created_ms, ',"updated_at":', updated_ms, '}}')
        from e where league in (select league from wanted)""",
    "parse_log_lines": f"""select event_id,
        case when not continued then strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' end as time,
        case when not continued then level end as level,
        case when not continued then '<0.' || user_id || '.0>' end as pids,
        case when not continued then case md when 'x' then '' else md end end as modules,
        message, continued::int as continued from ({_LOG})""",
    "log_stream": f"""select case when not continued then level end as level, count(*) as n,
        sum(length(message))::bigint as chars from ({_LOG}) group by 1""",
}

ORACLE["log_records"] = f"""with l as ({_LOG}),
    g as (select *, sum((not continued)::int) over (order by event_id) as record,
                 strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as stamp from l)
    select any_value(stamp) filter (not continued) as time, any_value(level) filter (not continued) as level,
           any_value('<0.' || user_id || '.0>') filter (not continued) as pids,
           any_value(case md when 'x' then '' else md end) filter (not continued) as modules,
           string_agg(message, chr(10) order by event_id) as message, 0 as continued, count(*) as lines
    from g where record > 0 group by record
    union all select null, null, null, null, message, 1, 1 from g where record = 0"""
ORACLE["log_records_stream"] = ORACLE["log_records"]

_PAGE_RESULTS = f"""page_rows as (
        select page_id, source, league, fetched_ms, pos, date, score,
               case when source = 'bbc' then home_text || ' vs ' || away_text
                    else trim(regexp_replace(home_text, '\\s+', ' ', 'g')) || ' vs ' ||
                         trim(regexp_replace(away_text, '\\s+', ' ', 'g')) end as name
        from fixtures),
    page_results as (
        select page_id, source, league, fetched_ms, pos, date, score, name
        from page_rows where source = 'bbc' union all
        select page_id, source, league, fetched_ms,
               row_number() over (partition by page_id order by date, name, seen) as pos,
               date, score, name
        from (select page_id, source, league, fetched_ms, min(date) as date, min(pos) as seen,
                     score, name from page_rows where source = 'fishy'
              group by page_id, source, league, fetched_ms, score, name))"""

ORACLE["pages_to_events"] = f"""with {_aliases()}, {_FIXTURES}, {_PAGE_RESULTS},
    {_matchups('page_results')},
    canonical as (select p.* replace (r.canonical as name) from page_results p
                  join resolved r on p.league = r.league and p.name = r.name),
    {_consolidate('canonical', 'fetched_ms', '')}
    select * from consolidated"""
ORACLE["ingest_stream"] = ORACLE["pages_to_events"]
ORACLE["ingest_errors"] = ORACLE["parse_errors"]
_INGESTED = f"with {_aliases()}, {_FIXTURES}, {_PAGE_RESULTS}, {_matchups('page_results')}"
# Every other league's entities have a longer name from the second half of the pages on.
_LATER = "page_id % 16 >= 8 and substr(p.league, 2)::int % 2 = 0"
ORACLE["ingest_changed_dictionary"] = f"""{_INGESTED},
    canonical as (select p.* replace (case when {_LATER}
                  then replace(r.canonical, ' vs ', ' FC vs ') || ' FC' else r.canonical end as name)
                  from page_results p join resolved r on p.league = r.league and p.name = r.name),
    {_consolidate('canonical', 'fetched_ms', '')}
    select * from consolidated"""
ORACLE["ingest_counts"] = f"""{_INGESTED}
    select count(*) as parsed, 0::bigint as failed,
           count(distinct (p.league, p.name, {_LATER})) as resolved from page_results p"""
ORACLE["ingest_report"] = f"""{_INGESTED},
    annotated as (select p.*, r.canonical from page_results p
                  left join resolved r on p.league = r.league and p.name = r.name)
    select source, league, count(*) as parsed,
           count(distinct case when canonical is not null then name end) as matched,
           count(*) filter (canonical is null) as unmatched_rows,
           count(distinct case when canonical is null then name end) as unmatched_names
    from annotated group by source, league"""
ORACLE["ingest_unmatched"] = f"""with {_aliases()}, {_FIXTURES}, {_PAGE_RESULTS},
    {_matchups('page_results')}
    select distinct league, name from page_results p
    where not exists (from resolved r where r.league = p.league and r.name = p.name)"""

ORACLE["table_results_quoted"] = ORACLE["table_results"]
