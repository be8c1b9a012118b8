"""Catalogue inputs derived from the given tables, in SQL that Spark and DuckDB both run.

Every view covers its base tables whole and grows with them:

* shows from ``part`` (channels from ``supplier`` and ``nation``), episodes from ``orders``,
  file names from ``lineitem``, requests from ``customer``, assignments from ``orders``;
* which layout, channel form or request form a row takes follows from its attributes, so
  that every branch of the operators meets data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

DRIVING = ("lineitem", "orders", "documents", "pages")

VIEWS = {
    # One show per part; names are unique, IDs start at 1 because 0 means "unknown".
    "shows": """
select cast(p_partkey + 1 as int) show_id,
  concat(upper(substr(p_name,1,1)), substr(p_name,2,instr(p_name,' ')-1),
         upper(substr(p_name,instr(p_name,' ')+1,1)), substr(p_name,instr(p_name,' ')+2), ' ',
         upper(substr(code,1,1)), substr(code,2)) name,
  p_name, p_type, p_brand, p_size
from (select *, translate(cast(p_partkey as varchar(12)),'0123456789','abdfghklmn') code from part) p""",
    # The channel a show runs on and its country.
    "channels": """
select show_id channel_of, s_name channel, n_name country
from (select cast(p_partkey + 1 as int) show_id, p_partkey % (select count(*) from supplier) channel_key from part) p
join supplier on s_suppkey = channel_key join nation on n_nationkey = s_nationkey""",
    # One episode per order: up to three in a season, seasons numbered from 1 to about 15.
    "episodes": """
select o_orderkey ep_key, show_id, cast(show_id % 12 + 1 + floor(k / 3) as int) season,
  cast(1 + k % 3 as int) episode, cast(o_orderkey + 1 as int) episode_id,
  concat('The ', upper(substr(c_mktsegment,1,1)), lower(substr(c_mktsegment,2)), ' ',
         upper(substr(code,1,1)), substr(code,2)) title, o_orderstatus, o_orderpriority
from (select *, cast(o_orderkey % (select count(*) from part) + 1 as int) show_id,
        cast(floor(o_orderkey / (select count(*) from part)) as bigint) k,
        translate(cast(o_orderkey as varchar(12)),'0123456789','abdfghklmn') code
      from orders) o
join customer on o_custkey = c_custkey""",
    # One file per line item, with the values its name was made of alongside.
    "files": """
select concat('/incoming/', cast(l_suppkey as varchar(20)), '/', cast(l_partkey as varchar(20)), '/', filename) path,
  input_ord, path_type, request_id, filename, layout, true_series, true_season, true_episode, true_title,
  show_id, l_shipdate, case when o_orderstatus = 'P' and layout = 0 then
    concat('/incoming/', cast(l_suppkey as varchar(20)), '/', cast(l_partkey as varchar(20)), '/', spelled, ' -', ss, '.', ee, '- ', title, '.mkv') end sibling
from (select f.*, case layout
    when 0 then concat(replace(spelled,' ','.'),'.S',ss,'E',ee,'.',replace(title,' ','.'),'.720p.HDTV.x264-GRP.mkv')
    when 1 then lower(concat(replace(spelled,' ','.'),'.S',ss,'E',ee,'.HDTV.avi'))
    when 2 then concat(replace(spelled,' ','.'),'.(2014).',cast(season as varchar(3)),ee,'.',replace(title,' ','.'),'.HDTV.mp4')
    when 3 then concat(replace(lower(spelled),' ','.'),'.',ss,ee,'.',lower(replace(title,' ','.')),'.WEB.mp4')
    when 4 then concat(spelled,' -',ss,'.',ee,'- ',title,'.avi')
    when 5 then concat(spelled,' ',ss,ee,' - ',title,'.mkv')
    when 6 then concat(spelled,' S',ss,'E',ee,' ',title,' (1080p x265).mkv')
    else concat(replace(spelled,' ','.'),'.sample.mkv') end filename,
  case when layout = 7 then '' else spelled end true_series,
  case when layout = 7 then 0 else season end true_season,
  case when layout = 7 then 0 else episode end true_episode,
  case when layout in (1, 7) then '' else title end true_title
from (select l_suppkey, l_partkey, l_shipdate, o_orderstatus, e.show_id, season, episode, title, l_orderkey request_id,
        l_orderkey * 8 + l_linenumber input_ord,
        case when l_linenumber = 7 and l_returnflag = 'R' then 'directory'
             when l_linenumber = 7 and l_returnflag = 'A' then 'absent' else 'file' end path_type,
        case when l_linestatus = 'O' and l_returnflag = 'N' then concat(name, ' Us') else name end spelled,
        cast((l_orderkey + l_linenumber) % 8 as int) layout,
        lpad(cast(season as varchar(3)),2,'0') ss, lpad(cast(episode as varchar(3)),2,'0') ee
      from lineitem join episodes e on l_orderkey = e.ep_key join shows h on e.show_id = h.show_id) f) x""",
    # One path on disk per present file: its own, or a canonically named one beside it.
    "listing": """
select coalesce(sibling, path) path from files where path_type <> 'absent'""",
    # Each path is announced twice, six hours apart, at the time of an event. Announcements land in slices of ten
    # days, but those of every second error not before the third slice: too late unless within the delay.
    "announcements": """
select path, seen, slice from (
  select path, began seen, slice from placed union all select path, began + interval '6' hour seen, slice from placed) x""",
    "placed": """
select path, cast(ts as timestamp) began, case when event_type = 'error' and event_id % 2 = 0 or extract(day from ts) > 20 then 2
  when extract(day from ts) > 10 then 1 else 0 end slice
from (select path, min(input_ord) % (select count(*) from events) event_of from files group by path) f
join events on event_id = event_of""",
    # Alias pairs in two layers; the second overrides the first where both have a variant.
    "alias_layers": """
select 1 layer, show_id line, concat(upper(name), ' US ') variant, concat(name, ' Archive') preferred
from shows where p_size <= 30
union all
select 2 layer, show_id line, concat(name, ' Us') variant, name preferred
from shows where p_type in ('STANDARD', 'LARGE', 'MEDIUM')""",
    "known_ids": """
select name series, case when p_size = 50 then 'n/a' else cast(show_id as varchar(12)) end id
from shows where p_size > 15""",
    # Free-text searches: two-word names, longer spellings, names one letter short, exact names.
    "searches": """
select p_name query from part
union all select concat(name, ' Us') query from shows
union all select substr(name, 1, length(name) - 1) query from shows
union all select upper(name) query from shows""",
    "show_payloads": """
select show_id, name, p_size, concat('{"id":', cast(show_id as varchar(12)), ',"url":"https://catalogue.example/shows/',
  cast(show_id as varchar(12)), '","name":"', name, '","type":"', p_type, '","genres":["Drama","', p_brand, '"],"status":',
  case when p_size > 25 then '"Ended"' else '"Running"' end,
  ',"premiered":', case when p_size = 7 then 'null' else concat('"20', lpad(cast(p_size % 25 as varchar(2)),2,'0'), '-03-1', cast(p_size % 10 as varchar(2)), '"') end,
  ',"rating":{"average":', cast(p_size as varchar(2)), '.5}',
  ',"network":', case when p_size <= 20 then concat('{"id":1,"name":"', channel, '","country":{"name":"', country, '","code":"XX","timezone":"UTC"}}')
                      when p_size <= 30 then concat('{"id":2,"name":"', channel, '","country":null}') else 'null' end,
  ',"webChannel":', case when p_size > 40 and p_size <= 45 then concat('{"id":3,"name":"', channel, ' Web","country":{"name":"', country, '"}}')
                         when p_size > 30 and p_size <= 40 then concat('{"id":4,"name":"', channel, ' Web","country":null}') else 'null' end,
  ',"summary":', case when p_brand = 'Brand#5' then 'null' else concat('"<p><b>', name, '</b> is a ', p_type, ' &amp; <i>', p_name, '</i> show.</p>"') end,
  '}') payload
from shows join channels on show_id = channel_of""",
    # Search results per show: none, one, or three candidates, the last without a show in it.
    "search_payloads": """
select lower(name) query, p_size, case when p_size <= 5 then '[]'
  when p_size <= 20 then concat('[{"score":0.9,"show":', payload, '}]')
  else concat('[{"score":0.9,"show":', payload, '},{"score":0.5,"show":{"id":', cast(show_id + 1000000 as varchar(12)),
    ',"name":"', name, ' Uk","premiered":"2001-01-01","webChannel":{"id":9,"name":"Stream","country":null}}},{"score":0.25}]') end payload
from show_payloads""",
    # Three seasons per show, the middle number listed twice for larger shows.
    "season_payloads": """
select show_id series_id, concat('[', one, ',', two, case when p_size > 40 then concat(',', twin) else '' end, ',', three, ']') payload
from (select show_id, p_size,
  concat('{"id":', cast(show_id * 10 + 1 as varchar(12)), ',"number":', cast(show_id % 12 + 1 as varchar(3)), ',"name":"","episodeOrder":3,"premiereDate":"2001-01-01","url":"https://catalogue.example/seasons/', cast(show_id * 10 + 1 as varchar(12)),
    '","network":{"id":1,"name":"', channel, '","country":null},"image":{"medium":"m', cast(show_id as varchar(12)), '","original":null},"summary":"<p>First of ', name, '</p>"}') one,
  concat('{"id":', cast(show_id * 10 + 2 as varchar(12)), ',"number":', cast(show_id % 12 + 2 as varchar(3)), ',"name":"Two","episodeOrder":null,"premiereDate":null}') two,
  concat('{"id":', cast(show_id * 10 + 4 as varchar(12)), ',"number":', cast(show_id % 12 + 2 as varchar(3)), ',"name":"Twin","episodeOrder":1}') twin,
  concat('{"id":', cast(show_id * 10 + 3 as varchar(12)), ',"number":', cast(show_id % 12 + 3 as varchar(3)), ',"name":"Three","episodeOrder":2,"endDate":"2003-01-01","network":null,"webChannel":{"id":3,"name":"', channel,
    ' Web","country":{"name":"', country, '"}}}') three
  from shows join channels on show_id = channel_of) s""",
    "episode_payloads": """
select show_id series_id, concat('{"id":', cast(episode_id as varchar(12)), ',"url":"https://catalogue.example/episodes/',
  cast(episode_id as varchar(12)), '","name":"', title, '","season":', cast(season as varchar(3)), ',"number":', cast(episode as varchar(3)),
  ',"type":"regular","airdate":"2012-0', cast(episode as varchar(3)), '-11","airstamp":"2012-0', cast(episode as varchar(3)),
  '-11T01:30:00+00:00","runtime":60,"summary":', case when o_orderstatus = 'O' then 'null'
  else concat('"<p>', title, ' &lt;', o_orderpriority, '&gt;</p>"') end, '}') payload
from episodes""",
    # Lookup requests of every form, some of them not allowed.
    "requests": """
select c_custkey request_id,
  case when c_mktsegment = 'BUILDING' then '' else name end series,
  case when c_mktsegment in ('BUILDING', 'HOUSEHOLD') then show_id else 0 end series_id,
  case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then season else 0 end season,
  case when c_mktsegment in ('AUTOMOBILE', 'MACHINERY') then 1 + c_nationkey % 3 else 0 end episode
from (select customer.*, cast(c_custkey % (select count(*) from part) + 1 as int) show_key from customer) c
join (select show_id, name, show_id % 12 + 1 season from shows) s on show_key = show_id""",
    # Assignments: one request per order, its line items are the files.
    "assignments": """
select ep_key request_id, name series, season, case when o_orderstatus = 'F' then episode else 0 end episode
from episodes e join shows h on e.show_id = h.show_id""",
    "choices": """
select lower(name) query, cast(floor(p_size / 12) as int) choice from shows""",
}


def needs(sql: str, names: Iterable[str]) -> list[str]:
    """Which of the named tables a piece of SQL reads."""
    return [n for n in names if re.search(rf"\b(?:from|join) {n}\b", sql)]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the views it needs, and those they need, as common table expressions."""
    views = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def add(sql: str, own: str = "") -> None:
        for name in needs(sql, views):
            if name != own and name not in ordered:
                add(views[name], name)
                ordered.append(name)

    add(body)
    if not ordered:
        return body
    return "with " + ", ".join(f"{name} as ({views[name]})" for name in ordered) + "\n" + body


def query(
    spark: SparkSession, sf_dir: str, body: str, tables: dict[str, str] | None = None
) -> DataFrame:
    """SQL over the given tables and derived views. ``tables`` may replace given tables."""
    used = {t: _table(spark, sf_dir, t) for t in needs(with_views(body), TABLES)}
    return spark.sql(with_views(body, {t: (tables or {}).get(t, sql) for t, sql in used.items()}))


# Schemas of the given tables by path, so that each footer is read once per session.
_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A given table; one that drives heavy work but has fewer splits than cores is spread."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    table = spark.read.schema(_SCHEMAS[path]).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if name in DRIVING and table.rdd.getNumPartitions() < cores:
        table = table.repartition(cores)
    view_name = "given_" + re.sub(r"\W+", "_", path)
    table.createOrReplaceTempView(view_name)
    return f"select * from {view_name}"


def view(
    spark: SparkSession, sf_dir: str, name: str, tables: dict[str, str] | None = None
) -> DataFrame:
    """A derived view, or a given table, as a DataFrame."""
    return query(spark, sf_dir, f"select * from {name}", tables)
