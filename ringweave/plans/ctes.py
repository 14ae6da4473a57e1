"""Shared SQL building blocks of the oracles.

They restate the semantics event by event (everything up to the event, then
aggregate), not the step-scan form the Spark jobs use.
"""

from __future__ import annotations

import re

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _tidy(col: str) -> str:
    return f"lower({TRIM.format(col)})"


def _floor_to(v: str, n: int) -> str:
    return f"cast(({v} - {v} % {n}) / {n} as bigint)"


CTES: dict[str, str] = {}

CTES["okeys"] = f"""
  select o_orderkey k, o_custkey c, coalesce(s, 0) s, o_totalprice price, {_floor_to('o_custkey', 10)} blk, o_custkey % 10 pos,
         (o_custkey % 10 < 6 and {_floor_to('o_custkey', 10)} % 10 = 0) ring,
         cast((epoch(o_orderdate) - 788918400) / 86400 as bigint) d
  from orders left join (select l_orderkey, min(l_suppkey) s from lineitem group by 1) on l_orderkey = o_orderkey
"""
CTES["pay"] = f"""
  select k,
    'evt_' || lpad(k::varchar, greatest(9, length(k::varchar))::int, '0') event_id, 'mcht_' || lpad(s::varchar, greatest(5, length(s::varchar))::int, '0') merchant_id,
    'cust_' || lpad(c::varchar, greatest(7, length(c::varchar))::int, '0') customer_id, cast(floor(price) as bigint) amount_paise, 'INR' currency,
    case when k % 20 < 17 then case when ring then ' Ring' || blk || '.' || (k % 4) || '@YBL' else 'user' || c || '@okaxis ' end end upi_vpa,
    case when k % 41 = 0 then '12345'
         when ring then case k % 3 when 0 then '0' when 1 then '+91 ' else '' end || (9100000000 + blk * 10 + pos % 2)
         else '+91-' || (6000000000 + c) end phone,
    case when ring then 'DEV_R' || blk || '_' || (k % 2)
         when c % 7 = 0 and k % 4 = 0 then 'dev_h' || {_floor_to('c', 14)}
         when k % 53 = 0 then null else 'dev_' || c end device_id,
    case when k % 9 = 0 then null when k % 97 = 0 then 'not-an-email' else 'C' || c || '@Example.com' end email,
    case when k % 101 = 0 then '103.1.1.999' else '103.' || (10 + k % 90) || '.' || (1 + c % 254) || '.7' end ip,
    cast(1780272000 + d * 3060 + (k * 37) % 3060 as bigint) ts,
    case when k % 20 < 17 then 'upi' when k % 20 < 19 then 'card' else 'netbanking' end payment_method,
    case when ring and k % 10 < 2 then 'chargeback' when ring and k % 10 = 2 then 'refund_abuse'
         when k % 400 = 0 then 'chargeback' end prior_outcome
  from okeys
"""
CTES["lab"] = """
  select 'evt_' || lpad(k::varchar, greatest(9, length(k::varchar))::int, '0') event_id, ring is_fraud,
    case when ring then 'ring_' || lpad(blk::varchar, greatest(6, length(blk::varchar))::int, '0') end ring_id,
    case when ring then case when blk % 20 = 0 then 'sophisticated' else 'standard' end end ring_strategy
  from okeys
"""


def phone_sql(col: str) -> str:
    """Phone rule as SQL over a raw column."""
    bare = rf"regexp_replace(regexp_replace({col}, '[\s\-().]+', '', 'g'), '^\+', '')"
    local = (
        f"case when length({bare}) = 14 and {bare} like '0091%' then substr({bare}, 5) "
        f"when length({bare}) = 12 and {bare} like '91%' then substr({bare}, 3) "
        f"when length({bare}) = 11 and {bare} like '0%' then substr({bare}, 2) else {bare} end"
    )
    return rf"case when regexp_full_match({bare}, '\d+') and regexp_full_match({local}, '[6-9]\d{{9}}') then '+91' || {local} end"


def vpa_sql(col: str) -> str:
    v = _tidy(col)
    return rf"case when length({v}) <= 128 and regexp_full_match({v}, '[a-z0-9._-]{{1,64}}@[a-z]{{2,16}}') then {v} end"


def device_sql(col: str) -> str:
    v = _tidy(col)
    return f"case when length({v}) between 1 and 128 then {v} end"


def email_sql(col: str) -> str:
    v = _tidy(col)
    return rf"case when length({v}) <= 128 and regexp_full_match({v}, '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}') then {v} end"


def ip_sql(col: str) -> str:
    v = TRIM.format(col)
    octets = " and ".join(f"try_cast(split_part({v}, '.', {i}) as int) <= 255" for i in range(1, 5))
    return rf"case when regexp_full_match({v}, '\d{{1,3}}(\.\d{{1,3}}){{3}}') and {octets} then {v} end"


CTES["norm"] = f"""
  select *, {vpa_sql('upi_vpa')} upi_entity, {phone_sql('phone')} phone_entity, {device_sql('device_id')} device_entity,
    {email_sql('email')} email_entity, {ip_sql('ip')} ip_entity
  from pay
"""
CTES["ev"] = """
  select *, row_number() over (order by ts, event_id) rn,
    coalesce(prior_outcome in ('chargeback', 'refund_abuse', 'confirmed_fraud'), false) fraud
  from norm
"""
CTES["touch"] = """
  select event_id, customer_id c, merchant_id m, ts, rn, 'merchant' ntype, 'merchant:' || merchant_id node from ev
  union all select event_id, customer_id, merchant_id, ts, rn, 'upi', 'upi:' || upi_entity from ev where upi_entity is not null
  union all select event_id, customer_id, merchant_id, ts, rn, 'phone', 'phone:' || phone_entity from ev where phone_entity is not null
  union all select event_id, customer_id, merchant_id, ts, rn, 'device', 'device:' || device_entity from ev where device_entity is not null
  union all select event_id, customer_id, merchant_id, ts, rn, 'email', 'email:' || email_entity from ev where email_entity is not null
"""
CTES["lnk"] = """
  select c, ntype, node, min(rn) fl, min(ts) first_seen, max(ts) last_seen, count(*) event_count from touch group by all
"""
CTES["elnk"] = "select * from lnk where ntype <> 'merchant'"
# customers one shared-entity step away as of each event, the customer included
CTES["step1"] = """
  select distinct e.event_id, e.rn, e.ts, e.customer_id c, b.c c2
  from ev e join elnk a on a.c = e.customer_id and a.fl <= e.rn join elnk b on b.node = a.node and b.fl <= e.rn
  union select event_id, rn, ts, customer_id, customer_id from ev
"""
CTES["step2"] = """
  select distinct s.event_id, s.rn, b.c c2 from step1 s join elnk a on a.c = s.c2 and a.fl <= s.rn
  join elnk b on b.node = a.node and b.fl <= s.rn union select event_id, rn, c2 from step1
"""
CTES["step3"] = """
  select distinct s.event_id, s.rn, b.c c2 from step2 s join elnk a on a.c = s.c2 and a.fl <= s.rn
  join elnk b on b.node = a.node and b.fl <= s.rn union select event_id, rn, c2 from step2
"""
CTES["cnode"] = "select distinct s.event_id, s.rn, l.ntype, l.node from step1 s join lnk l on l.c = s.c2 and l.fl <= s.rn"
CTES["fraudster"] = "select customer_id c, min(rn) fs from ev where fraud group by 1"
# counts of an entity as stored at each of its touches
CTES["snap"] = """
  select t.node, t.ntype, t.event_id, t.rn, count(distinct b.node) merchant_count, count(distinct a.c) linked_identity_count
  from touch t join elnk a on a.node = t.node and a.fl <= t.rn
  join lnk b on b.c = a.c and b.ntype = 'merchant' and b.fl <= t.rn
  where t.ntype <> 'merchant' group by all
"""
CTES["snapread"] = """
  select n.event_id, n.ntype, n.node, arg_max(s.merchant_count, s.rn) merchant_count,
    arg_max(s.linked_identity_count, s.rn) linked_identity_count
  from cnode n join snap s on s.node = n.node and s.rn <= n.rn group by all
"""
CTES["f1"] = """
  select event_id, customers, devices, case when devices > 0 then round_even(customers / devices, 3) else 0.0 end v from
    (select event_id, count(*) customers from step1 group by 1)
    join (select event_id, count(*) filter (ntype = 'device') devices from cnode group by 1) using (event_id)
"""
CTES["f2"] = """
  select e.event_id, coalesce(max(merchant_count), 0) v from ev e
  left join snapread r on r.event_id = e.event_id and r.ntype in ('upi', 'phone', 'device') group by 1
"""
CTES["f3"] = """
  select e.event_id, case when exists (select 1 from step1 s join fraudster f on f.c = s.c2 and f.fs <= s.rn where s.event_id = e.event_id) then 1.0
    when exists (select 1 from step2 s join fraudster f on f.c = s.c2 and f.fs <= s.rn where s.event_id = e.event_id) then 0.6
    when exists (select 1 from step3 s join fraudster f on f.c = s.c2 and f.fs <= s.rn where s.event_id = e.event_id) then 0.216
    else 0.0 end::double v from ev e
"""
CTES["f4"] = """
  select s.event_id, count(distinct e.merchant_id) v from step1 s
  join ev e on e.customer_id = s.c2 and e.rn <= s.rn and e.ts >= s.ts - 259200 group by 1
"""
# earliest fraud time known by each event for each fraud customer in its cluster
CTES["burnt"] = """
  select s.event_id, s.rn, s.c2, min(x.ts) fraud_ts from step1 s
  join ev x on x.customer_id = s.c2 and x.fraud and x.rn <= s.rn group by all having min(x.ts) > 0
"""
CTES["f5"] = """
  select e.event_id, cast(coalesce(max(hit), 0) as bigint) v from ev e left join (
    select f.event_id, 1 hit from burnt f
    where exists (select 1 from touch t where t.c = f.c2 and t.ntype = 'upi' and t.rn <= f.rn group by t.node
                  having max(t.ts) between f.fraud_ts and f.fraud_ts + 172800)
      and exists (select 1 from cnode n join (select node, arg_min(ts, rn) born from touch group by 1) b on b.node = n.node
                  where n.event_id = f.event_id and n.ntype = 'upi' and b.born > f.fraud_ts)
  ) h on h.event_id = e.event_id group by 1
"""
CTES["f6"] = """
  select e.event_id, ((e.amount_paise between 50000 and 200000)::int + m.mean_hit::int) / 2 v from ev e join (
    select event_id, bool_and(mean between 50000 and 200000) mean_hit from (
      select s.event_id, s.c2, avg(x.amount_paise) mean from step1 s join ev x on x.customer_id = s.c2 and x.rn <= s.rn group by all)
    group by 1) m on m.event_id = e.event_id
"""
CTES["f7"] = """
  select s.event_id, round_even(avg((s.ts - b.born <= 604800)::int), 6) v from step1 s
  join (select customer_id c, arg_min(ts, rn) born from ev group by 1) b on b.c = s.c2 group by 1
"""
CTES["raw"] = """
  select e.event_id, e.customer_id, e.merchant_id, e.amount_paise, e.ts, e.rn, f1.v device_identity_ratio, f2.v cross_merchant_fanout, f3.v taint,
    f4.v velocity_merchants_72h, f5.v burn_rotate, f6.v amount_band_hit, f7.v new_identity_fraction
  from ev e join f1 using (event_id) join f2 using (event_id) join f3 using (event_id) join f4 using (event_id)
  join f5 using (event_id) join f6 using (event_id) join f7 using (event_id)
"""
CTES["feat"] = """
  select *, round_even(greatest(0.0, least(1.0, device_identity_ratio / 6.0)), 6)::double n_f1,
    round_even(greatest(0.0, least(1.0, (cross_merchant_fanout - 2) / 4.0)), 6)::double n_f2,
    taint n_f3, round_even(greatest(0.0, least(1.0, velocity_merchants_72h / 5.0)), 6)::double n_f4,
    burn_rotate::double n_f5, amount_band_hit::double n_f6, new_identity_fraction::double n_f7
  from raw
"""
DEFAULT = (14, 20, 24, 14, 10, 4, 14)
NAMES = (
    "device_identity_ratio", "cross_merchant_fanout", "taint_propagation", "velocity_72h", "burn_rotate",
    "amount_pattern", "new_identity_burst",
)


def contributions_sql(weights=DEFAULT) -> str:
    return ", ".join(f"round_even({float(w)}::double * n_f{i}, 4) c_{n}" for i, (n, w) in enumerate(zip(NAMES, weights), 1))


SCORE = "cast(round_even(greatest(0.0::double, least(100.0::double, " + " + ".join(f"c_{n}" for n in NAMES) + ")), 0) as bigint)"


def band_sql(score: str = "score", review: int = 35, block: int = 70) -> str:
    return f"case when {score} >= {block} then 'BLOCK_REC' when {score} >= {review} then 'REVIEW' else 'ALLOW' end"


CODES = """concat_ws(',', case when cross_merchant_fanout >= 3 then 'RNG_DEVICE_FANOUT' end,
    case when device_identity_ratio >= 5 or new_identity_fraction >= 0.5 then 'RNG_IDENTITY_FARM' end,
    case when taint >= 0.3 then 'RNG_TAINT_LINK' end, case when velocity_merchants_72h >= 3 then 'RNG_VELOCITY' end,
    case when burn_rotate = 1 then 'RNG_BURN_ROTATE' end, case when amount_band_hit >= 1.0 then 'RNG_AMOUNT_PATTERN' end)"""
CTES["scored"] = f"""
  select *, {band_sql()} verdict, {CODES} reason_codes from (select *, {SCORE} score from (select *, {contributions_sql()} from feat))
"""
CTES["outc"] = """
  select s.event_id, s.score, l.is_fraud, l.ring_id, l.ring_strategy, s.verdict, s.merchant_id, s.customer_id, s.ts, s.rn
  from scored s join lab l using (event_id)
"""


# --- final graph ---
CTES["fcl"] = "select distinct a.c, b.c c2 from elnk a join elnk b on b.node = a.node union select customer_id, customer_id from ev"
CTES["fnode"] = """
  select distinct f.c, l.ntype, l.node from fcl f join lnk l on l.c = f.c2
  union select c, 'customer', 'customer:' || c2 from fcl
"""
CTES["snaplast"] = """
  select node, ntype, arg_max(merchant_count, rn) merchant_count, arg_max(linked_identity_count, rn) linked_identity_count from snap group by all
"""
CTES["spread"] = """
  select 'customer:' || c node, 0 hop from fraudster
  union select case when s.node = 'customer:' || l.c then l.node else 'customer:' || l.c end, s.hop + 1
  from spread s join elnk l on (s.node = 'customer:' || l.c or s.node = l.node) where s.hop < 3
"""
CTES["tlevel"] = """
  select node, case min(hop) when 0 then 1.0 when 1 then 0.6 when 2 then 0.36 else 0.216 end::double fraud_taint from spread group by 1
"""
CTES["ikeys"] = """
  select event_id, customer_id c, 'customer:' || customer_id key from pay
  union all select event_id, customer_id, 'vpa:' || upi_vpa from pay where upi_vpa <> ''
  union all select event_id, customer_id, 'phone:' || phone from pay where phone <> ''
  union all select event_id, customer_id, 'device:' || device_id from pay where device_id <> ''
  union all select event_id, customer_id, 'email:' || email from pay where email <> ''
"""
CTES["ckey"] = "select distinct c, key from ikeys"
CTES["creach"] = """
  select distinct c, c r from ckey
  union select x.c, b.c from creach x join ckey a on a.c = x.r join ckey b on b.key = a.key
"""
CTES["comp"] = "select c customer_id, min(r) component from creach group by 1"
CTES["csize"] = """
  select component, count(*) n, arg_min(is_fraud, rn) is_fraud, min(rn) first_rn from ev join comp using (customer_id)
  join lab using (event_id) group by 1
"""
CTES["corder"] = """
  select *, row_number() over (partition by is_fraud order by n desc, first_rn) i, sum(n) over (partition by is_fraud) p from csize
"""
# component after component to the split with the largest deficit
CTES["deal"] = """
  select is_fraud, 0::bigint i, null::varchar component, null::varchar split, 0::bigint a, 0::bigint b, 0::bigint d from (select distinct is_fraud from corder)
  union all
  select is_fraud, i, component, split, a + case split when 'train' then n else 0 end, b + case split when 'calibration' then n else 0 end,
    d + case split when 'test' then n else 0 end from (
    select o.is_fraud, o.i, o.component, o.n, x.a, x.b, x.d,
      case when 0.6::double * o.p - x.a >= 0.2::double * o.p - x.b and 0.6::double * o.p - x.a >= 0.2::double * o.p - x.d then 'train'
           when 0.2::double * o.p - x.b >= 0.2::double * o.p - x.d then 'calibration' else 'test' end split
    from deal x join corder o on o.is_fraud = x.is_fraud and o.i = x.i + 1)
"""
CTES["splitlab"] = """
  select l.*, d.split, e.customer_id from lab l join ev e using (event_id) join comp c on c.customer_id = e.customer_id
  join deal d on d.component = c.component
"""


# all nodes with their attributes
NODE_SQL = """
  select n.node, n.ntype, n.first_seen, n.last_seen, n.event_count, n.amount_sum, n.confirmed_fraud,
    coalesce(s.merchant_count, 0) merchant_count, coalesce(s.linked_identity_count, 0) linked_identity_count, coalesce(t.fraud_taint, 0.0) fraud_taint
  from (
    select 'customer:' || customer_id node, 'customer' ntype, min(ts) first_seen, max(ts) last_seen, count(*) event_count,
      cast(sum(amount_paise) as bigint) amount_sum, bool_or(fraud) confirmed_fraud from ev group by customer_id
    union all select node, ntype, min(first_seen), max(last_seen), 0, 0, false from lnk group by all) n
  left join snaplast s on s.node = n.node left join tlevel t on t.node = n.node
"""


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prepend every CTE that ``body`` needs, each after those it reads."""
    pool = {**CTES, **(extra or {})}
    needed: set[str] = set()
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in set(re.findall(r"[a-z_][a-z_0-9]*", text)):
            if word in pool and word not in needed:
                if re.search(rf"\b(from|join)\s+\(?\s*{word}\b|,\s*{word}\s+[a-z0-9]+\s+(where|join)", text):
                    needed.add(word)
                    visit(pool[word])
                    ordered.append(word)

    visit(body)
    if not needed:
        return body
    recursive = {"spread", "creach", "deal", "kdeal"}
    parts = ",\n".join(f"{n} as {'' if n in recursive else 'materialized '}({pool[n]})" for n in ordered)
    return f"with recursive {parts}\n{body}"
