"""What each registered query must return, as SQL for DuckDB on the same tables.

The SQL takes other roads than the operators where it can: JSON is read by DuckDB's own
functions, search compares every query with every name, claims are plain windows.
"""

from __future__ import annotations

from reelspark.checks.inputs import with_views

# The file-name layouts as RE2 patterns, and the release tags.
SHAPES = (
    (r"(?i)^(.+?)\.+(\d{4}|\(\d{4}\))?\.*S(\d{2})\.?E(\d{2})\.*(.*)\.+(\w+)$", True),
    (r"(?i)^(.+?)\.+(\d{4}|\(\d{4}\))?\.(\d{1,2})(\d{2})\.*(.*)\.+(\w+)$", True),
    (r"(?i)^(.+)\.+S?(\d+)\.?E?(\d{2,})\.*(.*)\.+(\w+)$", False),
    (r"^(.+)\s+-(\d{2})\.(\d{2})-\s*(.*)\.(.+)$", False),
    (r"^(.+[^\s-])[\s-]+(\d{1,2})(\d{2,})[\s-]+(.*)\.(.+)$", False),
    (r"^(.+)S(\d{1,2})E(\d{2,})(.*)\.(.+)$", False),
)
TAGS = r"\(?(1080p|720p|HDTV|WEB|PROPER|REPACK|RERIP).*"

PARTS = ("series", "year", "season", "episode", "title", "extension")


def _shape_sql() -> str:
    tries = " ".join(
        f"when regexp_matches(filename, '{p}') then {i}" for i, (p, _) in enumerate(SHAPES, 1)
    )
    return f"case {tries} end"


def _part_sql(part: str) -> str:
    cases = []
    for i, (pattern, dated) in enumerate(SHAPES, 1):
        groups = PARTS if dated else tuple(p for p in PARTS if p != "year")
        value = f"regexp_extract(filename, '{pattern}', {groups.index(part) + 1})" if part in groups else "''"
        cases.append(f"when {i} then {value}")
    return f"case shape {' '.join(cases)} end"


# DuckDB knows no title case for this one letter.
UPPER = "case when w[1:1] = 'ß' then 'Ss' else upper(w[1:1]) end"


def title(x: str, letters: str = "[a-z]", others: str = "[^a-z]") -> str:
    return (
        f"coalesce(array_to_string(list_transform(regexp_extract_all(lower({x}), '{letters}+|{others}+'), "
        f"lambda w: concat({UPPER}, w[2:])), ''), '')"
    )


def caps(x: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform(string_split_regex(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), "
        f"lambda w: concat({UPPER}, lower(w[2:]))), ' '), '')"
    )


def untag(x: str) -> str:
    return f"regexp_replace({x}, '{TAGS}', '', 'gi')"


def pad(x: str) -> str:
    return f"case when {x} < 10 then concat('0', {x}) else cast({x} as varchar) end"


def display(series: str = "series", season: str = "season", episode: str = "episode", name: str = "title") -> str:
    return (
        f"concat(coalesce(nullif({series}, ''), 'Unknown'), ' -', {pad(season)}, '.', {pad(episode)}, '- ', "
        f"coalesce(nullif({name}, ''), 'Unknown'))"
    )


def key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


SUFFIX = r"regexp_extract(path, '(\.[^./]+)$', 1)"
PARENT = r"regexp_extract(path, '^(.*)/[^/]*$', 1)"
TARGET = f"concat({PARENT}, '/', {display()}, {SUFFIX})"


def shorter_names(x: str) -> str:
    """All names one word shorter."""
    return (
        f"list_transform(range(1, case when len(string_split({x}, ' ')) > 1 then len(string_split({x}, ' ')) else 0 end + 1), "
        f"lambda i: array_to_string(list_concat(string_split({x}, ' ')[1:i-1], string_split({x}, ' ')[i+1:]), ' '))"
    )


def pairs_sql(queries: str) -> str:
    """Every query beside every name, kept where equal, a character, a word or blanks apart, or with half of all words in common."""
    words = lambda x: f"list_distinct(string_split({x}, ' '))"
    return f"""
select query_key, name_key, show_id, n_shows,
  round(case when query_key = name_key then 1.0 else greatest(
    case when by_word then 1 - 1.0 / words else 0 end, case when by_char then 1 - 1.0 / chars else 0 end,
    case when share >= 0.5 then least(share, 1 - 1.0 / (words + 1)) else 0 end) end::double, 6) score
from (select *, common::double / (len(q_words) + len(n_words) - common) share
  from (select *, query_key = name_key or list_contains(q_shorter, name_key) or list_contains(n_shorter, query_key) by_word,
        query_key = name_key or q_joined = n_joined
          or (abs(length(query_key) - length(name_key)) <= 1 and levenshtein(query_key, name_key) = 1) by_char,
        len(list_intersect(q_words, n_words)) common,
        greatest(len(string_split(query_key, ' ')), len(string_split(name_key, ' '))) words,
        greatest(length(query_key), length(name_key)) chars
      from (select query_key, {shorter_names('query_key')} q_shorter, {words('query_key')} q_words,
              replace(query_key, ' ', '') q_joined from {queries}) q,
           (select *, {shorter_names('name_key')} n_shorter, {words('name_key')} n_words,
              replace(name_key, ' ', '') n_joined from o_index) n))
where by_word or by_char or share >= 0.5"""


def j(path: str, of: str = "payload") -> str:
    return f"json_extract_string({of}, '$.{path}')"


def text_or(x: str, other: str = "'None'") -> str:
    return f"coalesce(cast({x} as varchar), {other})"


# Show and episode summaries hold plain tags and the references &amp; &lt; &gt; only.
def plain(x: str) -> str:
    return (
        f"coalesce(replace(replace(replace(regexp_replace({x}, '<[a-zA-Z/][^>]*>', '', 'g'), "
        "'&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '')"
    )


SERIES_TEXT = (
    f"concat({text_or('name')}, ' - ID: ', show_id, ' - ', {text_or('url')}, chr(10), 'Premiered: ', "
    f"{text_or('premiered')}, ' - Status: ', {text_or('status')}, chr(10), {plain('summary')})"
)
EPISODE_TEXT = (
    f"concat(season, 'x', episode, ' - ', {text_or('title')}, chr(10), {text_or('url')}, chr(10), {plain('summary')})"
)

VIEWS = {
    "o_shaped": f"select *, {_shape_sql()} shape from files",
    "o_parts": "select *, " + ", ".join(f"{_part_sql(p)} {p}_part" for p in PARTS) + " from o_shaped",
    "o_named": f"""
select path, input_ord, path_type, request_id, shape,
  {title("trim(replace(coalesce(series_part, ''), '.', ' '))")} series,
  coalesce(try_cast(season_part as bigint), 0) season, coalesce(try_cast(episode_part as bigint), 0) episode,
  {caps(untag("trim(replace(coalesce(title_part, ''), '.', ' '))"))} title,
  case when shape is null then 'NO_MATCH' else 'MATCHED' end infer_status
from o_parts""",
    "o_aliases": """
select variant_key, preferred from (select lower(trim(variant)) variant_key, preferred,
  row_number() over (partition by lower(trim(variant)) order by layer desc, line desc) n from alias_layers) where n = 1""",
    "o_aliased": """
select o.* replace (coalesce(preferred, series) as series),
  case when preferred is null then 'NO_TRANSFORM_OPTION' else 'TRANSFORM' end alias_status
from o_named o left join o_aliases on lower(trim(series)) = variant_key""",
    "o_ids": "select lower(trim(series)) series_key, coalesce(try_cast(id as int), 0) series_id from known_ids",
    "o_index": f"select {key('name')} name_key, min(show_id) show_id, count(*) n_shows from shows group by 1",
    "o_keys": "select distinct lower(trim(series)) series_key from o_aliased where series <> ''",
    "o_unresolved": "select series_key from o_keys where series_key not in (select series_key from o_ids)",
    "o_unresolved_queries": f"select distinct {key('series_key')} query_key from o_unresolved",
    "o_series_pairs": pairs_sql("o_unresolved_queries"),
    "o_resolution": f"""
select series_key, series_id, 'known' id_source from o_keys join o_ids using (series_key)
union all
select series_key, coalesce(show_id, 0), case when show_id is null then 'none' else 'search' end
from o_unresolved left join (select *, row_number() over (partition by query_key order by score desc, show_id) n
  from o_series_pairs) on query_key = {key('series_key')} and n = 1""",
    "o_query_keys": f"select distinct {key('query')} query_key from searches",
    "o_search_pairs": pairs_sql("o_query_keys"),
    "o_fetched": """
select a.* replace (case when fetch_status in ('fetched', 'episode_not_found') then coalesce(fetched, '') else a.title end as title,
  coalesce(series_id, 0) as series_id, coalesce(id_source, 'none') as id_source)
from (select a.*, series_id, id_source, e.title fetched,
    case when coalesce(series_id, 0) = 0 then 'no_series_id' when a.season = 0 then 'no_season'
         when a.episode = 0 then 'no_episode' when e.title is null then 'episode_not_found' else 'fetched' end fetch_status
  from o_aliased a left join o_resolution r on lower(trim(series)) = series_key
  left join episodes e on e.show_id = series_id and e.season = a.season and e.episode = a.episode) a""",
    "o_errors": f"""
select *, {display()} display_name,
  case when path_type = 'absent' then 'missing' when infer_status <> 'MATCHED' then infer_status
       when fetch_status in ('no_series_id', 'no_season', 'no_episode') then fetch_status end error
from o_fetched""",
    "o_renames": f"""
select *, case when rename_target is null then null when path_type = 'absent' then 'missing'
    when rename_target = path then 'already_named'
    when taken or claim_no > 1 then 'conflict' else 'rename' end rename_action
from (select o.*, l.path is not null taken,
        row_number() over (partition by rename_target, rename_target = o.path or path_type = 'absent' order by input_ord, o.path) claim_no
      from (select *, case when error is null then {TARGET} end rename_target from o_errors) o
      left join listing l on l.path = rename_target)""",
    "o_moves": f"""
select *, case when organize_target is null then null when path_type = 'absent' then 'missing'
    when path_type <> 'file' then 'not_a_file' when organize_target = path then 'in_place'
    when taken_place or place_no > 1 then 'conflict' else 'move' end organize_action
from (select o.*, l.path is not null taken_place,
        row_number() over (partition by organize_target, path_type <> 'file' order by input_ord, o.path) place_no
      from (select *, case when error is null then concat('/library/', series, '/Season ', {pad('season')}, '/',
              regexp_extract(case when rename_action = 'rename' then rename_target else path end, '[^/]*$')) end organize_target
            from o_renames) o left join listing l on l.path = organize_target)""",
    "o_process": """
select path, input_ord, series, series_id, season, episode, title, display_name, rename_target, rename_action,
  organize_target, organize_action, 420 as mode, 'media' as owner, cast(null as varchar) as "group", infer_status,
  alias_status, fetch_status,
  coalesce(error, case when organize_action = 'not_a_file' then 'not_a_file'
    when rename_action = 'conflict' or organize_action = 'conflict' then 'conflict' else 'planned' end) status
from o_moves""",
    "o_shows": f"""
select show_id, {j('url')} url, {j('name')} name, {j('premiered')} premiered, {j('status')} status, {j('type')} "type",
  {j('summary')} summary, {j('network.name')} nw, {j('network.country.name')} nw_country,
  {j('webChannel.name')} wc, {j('webChannel.country.name')} wc_country, {j('genres[1]')} genre,
  cast({j('rating.average')} as double) rating from show_payloads""",
    "o_seasons": f"""
select series_id, cast(ord - 1 as int) ord, cast({j('id', 'item')} as int) season_id, cast({j('number', 'item')} as int) season,
  {j('name', 'item')} name, cast({j('episodeOrder', 'item')} as int) episode_order,
  {j('premiereDate', 'item')} premiere_date, {j('endDate', 'item')} end_date, {j('url', 'item')} url,
  {j('network.name', 'item')} network, {j('webChannel.country.name', 'item')} web_country, {j('image.medium', 'item')} image,
  {j('summary', 'item')} summary
from (select series_id, unnest(items) item, unnest(range(1, len(items) + 1)) ord
  from (select series_id, json_extract(payload, '$[*]') items from season_payloads))""",
    "o_season_ids": """
select series_id, season, season_id from (select *, row_number() over (partition by series_id, season order by ord) n
  from o_seasons) where n = 1""",
    "o_episodes": f"""
select series_id, cast({j('season')} as int) season, cast({j('number')} as int) episode, cast({j('id')} as int) episode_id,
  {j('name')} title, {j('url')} url, {j('summary')} summary, {j('airdate')} airdate from episode_payloads""",
    "o_hits": f"""
select query, cast(n as bigint) number, cast({j('score', 'hit')} as double) score, cast({j('show.id', 'hit')} as int) show_id,
  {j('show.name', 'hit')} name, {j('show.premiered', 'hit')} premiered,
  {j('show.network.name', 'hit')} nw, {j('show.network.country.name', 'hit')} nw_country,
  {j('show.webChannel.name', 'hit')} wc, {j('show.webChannel.country.name', 'hit')} wc_country
from (select query, unnest(hits) hit, unnest(range(1, len(hits) + 1)) n
  from (select query, json_extract(payload, '$[*]') hits from search_payloads))""",
    "o_season_text": f"""
select series_id, season, row_number() over (partition by series_id, season order by episode, episode_id) idx,
  {EPISODE_TEXT} "text" from o_episodes""",
    "o_requests": """
select r.*, case when series <> '' and series_id <> 0 then 'series_and_series_id'
    when series = '' and series_id = 0 then 'no_series' when episode <> 0 and season = 0 then 'episode_without_season' end reason
from requests r""",
    "o_dispatch": """
select *, case when found_id = 0 then 'none' when season <> 0 and episode <> 0 then 'episode'
    when season <> 0 then 'season' else 'series' end granularity
from (select request_id, season, episode, reason, case when reason is not null then 0
    when series = '' then series_id
    else coalesce((select i.series_id from o_ids i where i.series_key = lower(trim(r.series))),
                  (select s.show_id from shows s where lower(s.name) = lower(trim(r.series))), 0) end found_id
  from o_requests r)""",
    "o_accepted": """
select *, coalesce(reason0, case when series_id = 0 then 'no_series_id' when season = 0 then 'no_season' end) reason
from (select a.*, n_files, coalesce(i.series_id, s.show_id, 0) series_id,
    case when episode <> 0 and season = 0 then 'episode_without_season'
         when episode <> 0 and n_files <> 1 then 'not_one_file' end reason0
  from (select a.*, coalesce(n, 0) n_files from assignments a left join
    (select request_id, count(*) n from files group by 1) c using (request_id)) a
  left join o_ids i on i.series_key = lower(a.series) left join shows s on s.name = a.series)""",
    "o_single": f"""
select request_id, path, series, series_id, season, episode, title, {TARGET} rename_target, status
from (select f.path, a.request_id, a.series, a.series_id, a.season, a.episode, coalesce(e.title, '') title,
    case when e.title is null then 'episode_not_found' else 'fetched' end status
  from o_accepted a join files f using (request_id)
  left join o_episodes e on e.series_id = a.series_id and e.season = a.season and e.episode = a.episode
  where a.reason is null and a.episode <> 0)""",
    "o_placed": """
select path, request_id, cast(row_number() over (partition by request_id order by
  coalesce(try_cast(regexp_extract(filename, '^[0-9]+') as hugeint), 0), filename, path) as bigint) idx from files""",
    "o_season_files": f"""
select request_id, path, series, series_id, season, episode, title, case when episode is not null then {TARGET} end rename_target,
  case when episode is null then 'no_episode_left' else 'paired' end status
from (select f.path, a.request_id, a.series, a.series_id, a.season, e.episode, e.title
  from o_accepted a join o_placed f using (request_id)
  left join (select *, row_number() over (partition by series_id, season order by episode, episode_id) idx from o_episodes) e
    on e.series_id = a.series_id and e.season = a.season and e.idx = f.idx
  where a.reason is null and a.episode = 0)""",
}

LABEL_NETWORK = "coalesce(nw, wc, 'Unknown')"
LABEL_COUNTRY = "coalesce(case when nw is not null then nw_country else wc_country end, 'Unknown')"


def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_files"] = "select path, input_ord, path_type from files"
    q["scan_aliases"] = "select layer, line, lower(trim(variant)) variant_key, preferred from alias_layers"
    q["scan_series_ids"] = "select * from o_ids"
    q["scan_catalog_shows"] = 'select show_id, name, url, premiered, status, "type", nw network, wc web_channel, genre, rating from o_shows'
    q["scan_catalog_seasons"] = "select * from o_seasons"
    q["scan_catalog_episodes"] = "select *, cast(airdate as date) air_date from o_episodes"
    q["scan_search_results"] = "select query, number, score, show_id, name from o_hits"
    q["raw_payload"] = f"""select series_id, cast({j('season')} as int) season, cast({j('number')} as int) episode,
        payload "text" from episode_payloads"""
    q["sink_plan"] = q["process"] = q["stream_plan"] = "select * from o_process"
    q["merge_series_ids"] = """select * from o_ids union all
        select series_key, series_id from o_resolution where id_source = 'search'"""
    q["stream_learn_ids"] = q["merge_series_ids"]
    q["path_parts"] = f"""select path, {PARENT} parent, filename as name,
        regexp_extract(filename, '^(.*)\\.[^.]*$', 1) stem, {SUFFIX} suffix from files"""
    q["valid_files"] = """select path, case path_type when 'absent' then 'missing' when 'directory' then 'not_a_file'
        else 'ok' end status from files"""
    q["infer"] = "select path, shape, " + ", ".join(f'{p}_part "{p}"' for p in PARTS) + " from o_parts"
    q["infer_unmatched"] = "select path, infer_status from o_named where shape is null"
    q["metadata_struct"] = """select path, to_json({'series': series, 'season': season, 'episode': episode,
        'title': title}) metadata from o_named"""
    q["numeric_fields"] = "select path, season, episode from o_named"
    q["normalize_series"] = "select path, series from o_named"
    q["normalize_title"] = "select path, title from o_named"
    q["display_name"] = f"select path, {display()} display_name from o_named"
    q["target_dir"] = f"select path, concat('/library/', series, '/Season ', {pad('season')}) target_dir from o_named"
    q["rename_target"] = f"select path, {TARGET} rename_target from o_named"
    q["organize_target"] = f"""select path, concat('/library/', series, '/Season ', {pad('season')}, '/',
        regexp_extract(path, '[^/]*$')) organize_target from o_named"""
    q["rename_action"] = f"""select path, rename_target, case when path_type = 'absent' then 'missing'
          when rename_target = path then 'already_named' when taken or claim_no > 1 then 'conflict' else 'rename' end rename_action
        from (select o.*, l.path is not null taken, row_number() over (
            partition by rename_target, rename_target = o.path or path_type = 'absent' order by input_ord, o.path) claim_no
          from (select *, {TARGET} rename_target from o_named) o left join listing l on l.path = rename_target)"""
    q["plan_attrs"] = """select path, 420 as mode, 'media' as owner, cast(null as varchar) as "group" from files"""
    q["step_toggles"] = f"""
        select 'infer only' toggles, path, {display()} display_name, cast(null as varchar) rename_target,
          cast(null as varchar) organize_target, case when path_type = 'absent' then 'missing'
          when infer_status <> 'MATCHED' then infer_status else 'planned' end status from o_aliased
        union all
        select 'rename only', path, display_name, case when error is null then rename_target end, null, case
          when error is not null then error when rename_target <> path and (taken or claim_no > 1) then 'conflict' else 'planned' end
        from (select o.*, l.path is not null taken, row_number() over (
            partition by rename_target, rename_target = o.path or error is not null order by input_ord, o.path) claim_no
          from (select *, {display()} display_name, {TARGET} rename_target, case when path_type = 'absent' then 'missing'
            when infer_status <> 'MATCHED' then infer_status end error from o_aliased) o
          left join listing l on l.path = rename_target)"""
    q["lookup_errors"] = "select path, case when fetch_status in ('no_series_id', 'no_season', 'no_episode') then fetch_status end lookup_error from o_fetched"
    q["request_validate"] = "select request_id, reason from o_requests"
    q["assignment_validate"] = "select request_id, n_files, series_id, reason from o_accepted"
    q["request_dispatch"] = "select request_id, found_id, granularity, reason from o_dispatch"
    q["join_aliases"] = "select path, series, alias_status from o_aliased"
    q["join_local_ids"] = """select path, series, series_id local_id from o_aliased
        left join o_ids on series_key = lower(trim(series))"""
    q["unresolved_series"] = "select series_key from o_unresolved"
    q["search_candidates"] = "select query_key, name_key, score, show_id, n_shows from o_search_pairs"
    q["resolve_best"] = "select series_key, series_id from o_resolution where id_source <> 'known'"
    q["resolve_series_id"] = "select series_key, series_id, id_source from o_resolution"
    shown = "show_id series_id, name, url, premiered"
    q["join_show"] = f"select path, {shown} from files join o_shows using (show_id)"
    q["join_show_seasons"] = "select show_id series_id, s.ord, s.season_id, s.season from shows join o_seasons s on s.series_id = show_id"
    q["season_id"] = """select path, coalesce(season_id, 0) season_id from files left join o_season_ids
        on series_id = show_id and season = true_season"""
    q["season_episodes"] = """select r.request_id, r.season, e.episode, e.title from
        (select request_id, found_id series_id, season from o_dispatch where granularity = 'season') r
        join o_episodes e using (series_id, season)"""
    q["episode_title"] = """select path, case when show_id = 0 then null else e.title end fetched_title,
        case when true_season = 0 then 'no_season' when e.title is null then 'episode_not_found' else 'fetched' end fetch_status
        from files left join o_episodes e on series_id = show_id and season = true_season and episode = true_episode"""
    q["enrich"] = "select path, series_id, id_source, title, fetch_status from o_fetched"
    q["apply_single"] = "select * from o_single"
    q["apply_season"] = "select * from o_season_files"
    q["apply"] = """select request_id, path, series, series_id, season, episode, title, rename_target, status,
          case when rename_target is null then null when rename_target = path then 'already_named'
            when taken or claim_no > 1 then 'conflict' else 'rename' end rename_action
        from (select o.*, l.path is not null taken, row_number() over (
            partition by rename_target, rename_target = o.path order by request_id, o.path) claim_no
          from (select * from o_single union all select * from o_season_files
            union all select a.request_id, f.path, a.series, a.series_id, a.season, a.episode, null, null, a.reason
            from o_accepted a join files f using (request_id) where a.reason is not null) o
          left join (select distinct path from listing) l on l.path = rename_target)"""
    q["candidate_count"] = """select query_key, cast(coalesce(sum(n_shows), 0) as bigint) n_shows,
          case coalesce(sum(n_shows), 0) when 0 then 'none' when 1 then 'unique' else 'ambiguous' end outcome
        from o_query_keys left join o_search_pairs using (query_key) group by 1"""
    q["season_report"] = 'select series_id, season, idx, "text" from o_season_text'
    q["overlay_aliases"] = "select * from o_aliases"
    q["outcome_counts"] = """select stage, status, count(*) n from (
          select 'infer' stage, infer_status status from o_process union all select 'alias', alias_status from o_process
          union all select 'fetch', fetch_status from o_process union all select 'rename', rename_action from o_process
          union all select 'organize', organize_action from o_process union all select 'plan', status from o_process)
        where status is not null group by 1, 2"""
    ranked = "row_number() over (partition by query_key order by score desc, show_id, name_key)"
    q["number_candidates"] = f"select query_key, name_key, score, show_id, cast({ranked} as bigint) number from o_search_pairs"
    q["top1_per_query"] = f"select query_key, name_key, score, show_id from (select *, {ranked} n from o_search_pairs) where n = 1"
    q["pick_nth"] = """select c.query, cast(choice as bigint) choice, coalesce(show_id, 0) series_id,
        case when number is null then 'invalid_choice' when show_id is null then 'no_show' else 'picked' end status
        from choices c left join o_hits h on h.query = c.query and number = choice"""
    q["dest_conflicts"] = f"""select path, target, case when row_number() over (partition by target order by input_ord, path) = 1
        then 'first' else 'conflict' end claim from (select path, input_ord, concat('/library/', series, '/Season ',
        {pad('season')}, '/', {display()}, {SUFFIX}) target from o_named)"""
    q["apply_ordinals"] = "select request_id, path, idx from o_placed"
    q["order_tv"] = """select path, series, season, episode, title, cast(row_number() over (
        order by path, series, season, episode, title) as bigint) "rank" from o_named"""
    q["natural_sort"] = """select filename, path, cast(row_number() over (order by
        coalesce(try_cast(regexp_extract(filename, '^[0-9]+') as hugeint), 0), filename, path) as bigint) "rank"
        from (select * replace (concat(cast(true_episode as varchar), case when true_title = '' then '' else ' ' || true_title end, '.mkv') as filename) from files)"""
    q["first_or_default"] = """select p.query, coalesce(arg_min(show_id, number) filter (where show_id is not null), 0) series_id
        from search_payloads p left join o_hits h on h.query = p.query group by 1"""
    letters, others = r"[\p{Lu}\p{Ll}]", r"[^\p{Lu}\p{Ll}]"
    q["title_case"] = f"select doc_id, {title('text', letters, others)} titled from documents"
    q["cap_words"] = f"select doc_id, {caps('text')} capped from documents"
    q["strip_release_tags"] = f"select path, {untag('filename')} cut from files"
    q["strip_tags"] = q["strip_tags_exact"] = _strip_tags_sql()
    urls = "https://catalogue.example"
    quoted = r"replace(replace(url_encode(name), '%20', '+'), '*', '%2A')"
    q["lookup_url"] = f"""select show_id, concat('{urls}/search/shows/?q=', {quoted}) search_url,
        concat('{urls}/singlesearch/shows/?q=', {quoted}) single_search_url,
        concat('{urls}/shows/', show_id, '/episodebynumber?season=', season, '&number=', 2) episode_url,
        concat('{urls}/seasons/', show_id * 10 + 1, '/episodes') season_episodes_url,
        concat('{urls}/shows/', show_id) show_url, concat('{urls}/shows/', show_id, '/seasons') show_seasons_url
        from (select show_id, concat(name, ' & ', p_type, '*~', p_size, '/', channel) as name, p_size season from shows join channels on show_id = channel_of)"""
    q["network_country"] = f"select show_id, {LABEL_NETWORK} network, {LABEL_COUNTRY} country from o_shows"
    known = lambda x: f"case when show_id is null then 'Unknown' else coalesce({x}, 'None') end"
    q["candidate_label"] = f"""select query, number, concat(number, '. ', {known('name')}, ' (Premiered: ', {known('premiered')},
        ', Network: ', {LABEL_NETWORK}, ', Country: ', {LABEL_COUNTRY}, ', ID: ', coalesce(show_id, 0), ')') label from o_hits"""
    q["series_text"] = f'select show_id series_id, {SERIES_TEXT} "text" from o_shows'
    q["episode_text"] = f'select series_id, season, episode, {EPISODE_TEXT} "text" from o_episodes'
    q["stream_dedup"] = """
        select * from (with tops as (select slice, max(seen) top from announcements group by 1),
        marks as (select s.slice, max(e.top) - interval 7 day mark from tops s join tops e on e.slice < s.slice group by 1),
        judged as (select path, coalesce(seen <= mark, false) late from announcements left join marks using (slice))
        select path, late, cast(1 as bigint) announced from judged where not late group by all
        union all select path, late, count(*) from judged where late group by 1, 2) x"""
    q["infer_report"] = "select path, series, series_id, season, episode, title, display_name, infer_status, fetch_status from o_errors"
    q["fetch_report"] = f"""
        select request_id, granularity, cast(1 as bigint) part, txt "text", case when txt is null then 'episode_not_found' else 'ok' end status
        from o_dispatch d left join (select series_id, season, episode, {EPISODE_TEXT} txt from o_episodes) e
          on e.series_id = found_id and e.season = d.season and e.episode = d.episode where granularity = 'episode'
        union all select request_id, granularity, coalesce(t.idx, 1), t."text", case when t."text" is null then 'season_not_found' else 'ok' end
        from o_dispatch d left join o_season_text t on t.series_id = found_id and t.season = d.season where granularity = 'season'
        union all select request_id, granularity, 1, txt, case when txt is null then 'series_not_found' else 'ok' end
        from o_dispatch d left join (select show_id, {SERIES_TEXT} txt from o_shows) on show_id = found_id where granularity = 'series'
        union all select request_id, granularity, 1, null, coalesce(reason, 'nothing_found') from o_dispatch where granularity = 'none'"""
    q["fetch_report_raw"] = f"""select * from (with raw as (select series_id, cast({j('season')} as int) season, cast({j('number')} as int) episode, payload,
          row_number() over (partition by series_id, {j('season')} order by cast({j('number')} as int), cast({j('id')} as int)) idx,
          row_number() over (partition by series_id, {j('season')}, {j('number')} order by cast({j('id')} as int)) nth from episode_payloads)
        select request_id, granularity, cast(case granularity when 'season' then coalesce(e.idx, 1) else 1 end as bigint) part,
          case granularity when 'series' then s.payload else e.payload end "text",
          case when granularity = 'none' then coalesce(reason, 'nothing_found')
            when coalesce(s.payload, e.payload) is null then concat(granularity, '_not_found') else 'ok' end status
        from o_dispatch d
        left join show_payloads s on granularity = 'series' and s.show_id = found_id
        left join raw e on e.series_id = found_id and e.season = d.season
          and (granularity = 'season' or granularity = 'episode' and e.episode = d.episode and nth = 1)) x"""
    return q


# Code points of the character references that web pages commonly hold.
REFERENCES = {
    "lt": 60, "gt": 62, "quot": 34, "#39": 39, "nbsp": 160, "copy": 169, "middot": 183, "mdash": 8212, "amp": 38,
}


def _strip_tags_sql() -> str:
    tags = r"(?is)<!--.*?-->|<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>|<[a-z/!?](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>|<[a-z/!?][^>]*>"
    out = f"regexp_replace(html, '{tags}', '\\1\\2', 'g')"
    for reference, code in REFERENCES.items():
        out = f"replace({out}, '&{reference};', chr({code}))"
    return f'select page_id, {out} "text" from pages'


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, VIEWS) for name, sql in _queries().items()}
