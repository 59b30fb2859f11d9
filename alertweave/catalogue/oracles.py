"""The same results in plain SQL, for checking on a small scale.

Fragments below are common table expressions that the statements put in front of themselves.
"""

from __future__ import annotations


# ---- alerts ---------------------------------------------------------------------------------
ALERTS = """
once as (
  select event_id as id, 'tenant_' || (user_id % 4) as tenant_id, cast(event_id as varchar) as source_event_id,
    ts as "timestamp",
    ts + to_minutes(cast(case when event_id % 20 = 0 then 180 else event_id % 7 end as integer)) as ingested_at,
    case event_type when 'signup' then 'IAM' when 'click' then 'IAM' when 'view' then 'FIREWALL' else 'XDR' end as source_type,
    'MockVendor' as source_vendor, 'Product_' || event_type as source_product, event_type as alert_type,
    case when value >= 150 then 'CRITICAL' when value >= 80 then 'HIGH' when value >= 40 then 'MEDIUM'
         when value >= 15 then 'LOW' else 'INFO' end as severity,
    case when value >= 150 then 5 when value >= 80 then 4 when value >= 40 then 3 when value >= 15 then 2 else 1 end as rank,
    case when event_type = 'view' then null when user_id % 37 = 0 then 'SYSTEM' else 'user_' || user_id end as "user",
    case when event_type in ('error', 'purchase') then 'host_' || (user_id // 3) end as host,
    '10.0.' || (user_id % 7) || '.' || (user_id % 50) as src_ip,
    case when event_type = 'view' then '203.0.113.' || (event_id % 200) end as dst_ip,
    case when event_type = 'error' then 'hash_' || json_extract_string(props, '$.k') end as file_hash,
    case event_type when 'view' then 'NETWORK_ACTIVITY' when 'signup' then 'AUTHENTICATION' when 'click' then 'AUTHENTICATION'
         else 'ENDPOINT_ACTIVITY' end as category_name
  from events
),
alerts as (
  select * from once
  union all
  select * replace (id + 1000000000 as id, "timestamp" + to_minutes(30) as ingested_at) from once where id % 10 = 0
)"""

FINGERPRINTED = ALERTS + """,
fingerprinted as (
  select *, 'exact-v1:' || sha256(tenant_id || ':' || source_type || ':' || source_vendor || ':' || source_product
    || ':' || source_event_id) as fp
  from alerts
),
arrivals as (
  select *, row_number() over (partition by tenant_id, fp order by ingested_at, id) as copy_no,
    first_value(id) over (partition by tenant_id, fp order by ingested_at, id) as first_id
  from fingerprinted
),
uniq as (select * from arrivals where copy_no = 1)"""


def uuid(text: str) -> str:
    h = f"sha256({text})"
    return f"""(substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12))"""


_KEY = """concat_ws(':', tenant_id, coalesce(alert_type,''), coalesce("user",''), coalesce(host,''), coalesce(src_ip,''),
    '', '', coalesce(file_hash,''))"""


def signals(minutes: int = 60, source: str = "uniq") -> str:
    return f"""
keyed as (select *, {_KEY} as aggregation_key from {source}),
stepped as (
  select *, case when "timestamp" - lag("timestamp") over w <= to_minutes({minutes}) then 0 else 1 end as opens
  from keyed window w as (partition by tenant_id, aggregation_key order by "timestamp", id)
),
islands as (
  select *, sum(opens) over (partition by tenant_id, aggregation_key order by "timestamp", id) as island from stepped
),
linked as (
  select *, first_value(id) over (partition by tenant_id, aggregation_key, island order by "timestamp", id) as anchor_id
  from islands
),
attached as (
  select *, {uuid("tenant_id || ':agg-default-v1:v1:' || aggregation_key || ':' || anchor_id")} as signal_id from linked
),
signals as (
  select tenant_id, aggregation_key, signal_id, any_value(anchor_id) as anchor_id, min("timestamp") as first_seen,
    max("timestamp") as last_seen, count(*) as occurrence_count, max(rank) as rank,
    ['INFO','LOW','MEDIUM','HIGH','CRITICAL'][max(rank)] as severity
  from attached group by all
)"""


ENTITIES = """
entities as (
  select distinct tenant_id, signal_id, e.t as entity_type, trim(e.v) as entity_value from (
    select tenant_id, signal_id, unnest([
      {'t': 'USER', 'v': "user"}, {'t': 'DEVICE', 'v': host}, {'t': 'IP', 'v': src_ip}, {'t': 'IP', 'v': dst_ip},
      {'t': 'HASH', 'v': file_hash}]) as e
    from attached)
  where e.v is not null and e.v <> ''
),
linkable as (
  select * from entities where entity_type in ('USER', 'DEVICE', 'IP', 'HASH')
    and not (entity_type = 'USER' and entity_value in ('SYSTEM', 'LOCAL SYSTEM', 'NETWORK SERVICE', 'LOCAL SERVICE', 'AUTHORITY\\SYSTEM'))
)"""


def pairs(limit: int = 1000) -> str:
    return f"""
placed as (select l.*, s.first_seen, s.last_seen from linkable l join signals s using (tenant_id, signal_id)),
directed as (
  select a.tenant_id, a.signal_id as a_id, b.signal_id as b_id,
    row_number() over (partition by a.tenant_id, a.entity_type, a.entity_value, a.signal_id
      order by b.last_seen desc, b.signal_id) as n
  from placed a join placed b using (tenant_id, entity_type, entity_value)
  where a.entity_type in ('USER', 'DEVICE', 'HASH') and a.signal_id <> b.signal_id
    and b.first_seen <= a.last_seen + interval 2 hour and b.last_seen >= a.first_seen - interval 2 hour
),
pairs as (
  select distinct tenant_id, least(a_id, b_id) as left_signal_id, greatest(a_id, b_id) as right_signal_id
  from directed where n <= {limit}
)"""


SCORED = """
shared as (
  select p.tenant_id, left_signal_id, right_signal_id, max(cast(l.entity_type = 'HASH' as int)) as h,
    max(cast(l.entity_type = 'DEVICE' as int)) as d, max(cast(l.entity_type = 'USER' as int)) as u,
    max(cast(l.entity_type = 'IP' as int)) as i
  from pairs p join linkable l on l.signal_id = left_signal_id
  join linkable r on r.signal_id = right_signal_id and l.entity_type = r.entity_type and l.entity_value = r.entity_value
  group by all
),
gapped as (
  select s.*, greatest(0, epoch_us(a.first_seen) - epoch_us(b.last_seen), epoch_us(b.first_seen) - epoch_us(a.last_seen)) as gap
  from shared s join signals a on a.signal_id = left_signal_id join signals b on b.signal_id = right_signal_id
),
scored as (
  select *, cast(50 * h + 40 * d + 25 * u + 15 * i
      + case when gap <= 300000000 then 15 when gap <= 3600000000 then 5 else 0 end as integer) as score,
    concat_ws(',', case when h = 1 then 'SAME_UNIQUE_HASH' end, case when d = 1 then 'SAME_DEVICE' end,
      case when u = 1 then 'SAME_USER' end, case when i = 1 then 'SAME_IP' end,
      case when gap <= 300000000 then 'TIME_PROXIMITY_5M' when gap <= 3600000000 then 'TIME_PROXIMITY_60M' end) as reasons
  from gapped
),
edges as (
  select *, """ + uuid("tenant_id || ':corr-v2:' || left_signal_id || ':' || right_signal_id") + """ as edge_id
  from scored where score >= 50
)"""

# Founders and joiners follow the ordered walk; what SQL can state from an empty state is who is in.
MEMBERS = """
members as (
  select tenant_id, left_signal_id as signal_id from edges union select tenant_id, right_signal_id from edges
  union select tenant_id, signal_id from signals where severity = 'CRITICAL'
)"""

SINGLETONS = """
singles as (
  select *, sha256(tenant_id || ':corr-v2:' || signal_id) as incident_key from signals s
  where severity = 'CRITICAL' and not exists (select 1 from edges e where s.signal_id in (left_signal_id, right_signal_id))
)"""

COMPONENTS = """
arcs as (select left_signal_id as a, right_signal_id as b from edges union all select right_signal_id, left_signal_id from edges),
reach as (
  select a as v, a as r from arcs
  union
  select arcs.b, reach.r from reach join arcs on arcs.a = reach.v
),
components as (select v as signal_id, min(r) as component from reach group by v)"""

# The ordered walk, one signal of every component a step. A component's state is three lists: incidents so far, who is in them,
# and what was decided.
WALK = """
ends as (
  select left_signal_id as signal_id, {'id': right_signal_id, 'score': score} as link from edges
  union all select right_signal_id, {'id': left_signal_id, 'score': score} from edges
),
around as (select signal_id, list(link) as links from ends group by signal_id),
anchored as (
  select signal_id, list(entity_type || ':' || entity_value order by entity_type || ':' || entity_value) as anchors
  from linkable where entity_type in ('USER', 'DEVICE', 'HASH') group by signal_id
),
nodes as (
  select component, signal_id, links, coalesce(anchors, []) as anchors, epoch_us(first_seen) as first_us,
    sha256(tenant_id || ':corr-v2:' || signal_id) as seed_key,
    row_number() over (partition by component order by first_seen, cast(anchor_id as varchar), signal_id) as n
  from signals join components using (signal_id) join around using (signal_id) left join anchored using (signal_id)
),
walk as (
  select distinct component, cast(0 as bigint) as n,
    cast([] as struct("key" varchar, first_us bigint, anchors varchar[])[]) as incs,
    cast([] as struct(id varchar, "key" varchar)[]) as holds,
    cast([] as struct(id varchar, "action" varchar, "key" varchar)[]) as decided
  from components
  union all
  select component, n,
    case when act = 'SEED' then list_append(incs, {'key': seed_key, 'first_us': first_us, 'anchors': anchors}) else incs end,
    case when act = 'JOIN' then list_append(holds, {'id': signal_id, 'key': best})
         when act = 'SEED' then holds || [{'id': signal_id, 'key': seed_key}] || [{'id': l.id, 'key': seed_key} for l in links]
         else holds end,
    case when act is null then decided
         else list_append(decided, {'id': signal_id, 'action': act, 'key': case act when 'JOIN' then best when 'SEED' then seed_key else own end})
         end
  from (
    select *, case when best is not null then 'JOIN' when own is not null then 'REFRESH' when len(anchors) > 0 then 'SEED' end as act
    from (
      select x.*, w.incs, w.holds, w.decided,
        list_sort([r for r in [{
            'top': -list_max([l.score for l in x.links if list_contains(w.holds, {'id': x.signal_id, 'key': i."key"})
                                                       or list_contains(w.holds, {'id': l.id, 'key': i."key"})]),
            'overlap': -len(list_intersect(x.anchors, i.anchors)), 'first_us': i.first_us, 'key': i."key"}
          for i in w.incs] if r.top is not null and r.overlap < 0])[1]."key" as best,
        list_sort([{'first_us': i.first_us, 'key': i."key"} for i in w.incs
          if list_contains(w.holds, {'id': x.signal_id, 'key': i."key"})])[1]."key" as own
      from walk w join nodes x on x.component = w.component and x.n = w.n + 1))
),
decisions as (
  select d.id as signal_id, d."action" as act, d."key" as incident_key
  from (select unnest(decided) as d from walk w where n = (select max(n) from nodes x where x.component = w.component))
  union all select signal_id, 'SINGLETON', incident_key from singles
),
acted as (select s.*, act, incident_key from decisions join signals s using (signal_id)),
updates as (
  select incident_key, max(last_seen) as seen, max(case when rank >= 4 then rank else 0 end) as risen
  from acted where act in ('JOIN', 'REFRESH') group by incident_key
),
assigned as (
  select tenant_id, incident_key, signal_id, first_seen,
    case act when 'SEED' then 'CORRELATED_INCIDENT' else 'SINGLETON_DETECTION' end as incident_type,
    case act when 'SEED' then 'Correlated Incident ' else 'Critical Detection ' end || substr(incident_key, 1, 8) as title,
    greatest(last_seen, coalesce(seen, last_seen)) as last_seen,
    ['INFO','LOW','MEDIUM','HIGH','CRITICAL'][greatest(rank, coalesce(risen, 0))] as severity
  from acted left join updates using (incident_key) where act in ('SEED', 'SINGLETON')
),
held as (
  select tenant_id, incident_key, signal_id from acted where act <> 'REFRESH'
  union select tenant_id, incident_key, link.id from acted join ends using (signal_id) where act = 'SEED'
)"""


def through_incidents(minutes: int = 1440) -> str:
    return "with recursive " + ",".join([through_edges(minutes)[5:], COMPONENTS, SINGLETONS, WALK])


def base(minutes: int = 60) -> str:
    return "with " + FINGERPRINTED + "," + signals(minutes)


def through_edges(minutes: int = 1440) -> str:
    return base(minutes) + "," + ENTITIES + "," + pairs() + "," + SCORED


SIGNAL_COLUMNS = """tenant_id, aggregation_key, signal_id, epoch_us(first_seen) as first_us, epoch_us(last_seen) as last_us,
  occurrence_count, severity"""

