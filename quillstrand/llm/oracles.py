"""SQL of the queries whose text is made from their parameters."""

from __future__ import annotations

from .centroids import Centroids
from .collocations import Phrases


def centroid_sql(spec: Centroids = Centroids()) -> str:
    """k-means with a pair of steps for each round."""
    steps = [
        f"""v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({spec.scale} * cast(x as double)) as bigint)) as e
  from embeddings where len(embedding) = {spec.dims} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), c0 as materialized (select row_number() over (order by sha256('{spec.seed}' || vec_id), e) - 1 as c, e from v qualify c < {spec.k})"""
    ]
    near = """select r, arg_min(c, [d, c]) as c, min(d) as d from (
    select r, c, list_sum(list_transform(list_zip(v.e, z.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c{0} z) group by r"""
    for i in range(spec.rounds):
        steps.append(f"n{i} as materialized ({near.format(i)})")
        steps.append(f"""s{i} as (select c, j, sum(e[j]) as s, count(*) as n from (select c, e, unnest(range(1, {spec.dims + 1})) as j from n{i} join v using (r)) group by 1, 2)""")
        steps.append(f"m{i} as (select c, list((s - ((s % n) + n) % n) // n order by j) as e from s{i} group by 1)")
        steps.append(f"c{i + 1} as materialized (select c, coalesce(m{i}.e, c{i}.e) as e from c{i} left join m{i} using (c))")
    steps.append(f"n as materialized ({near.format(spec.rounds)})")
    return f"""with {', '.join(steps)}
select vec_id, cast(n.c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by n.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(z.e, ',')) as centroid_sha256 from n join v using (r) join c{spec.rounds} z on z.c = n.c"""


def phrase_sql(spec: Phrases = Phrases()) -> str:
    """Every phrase of every piece, counted."""
    return rf"""with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), p as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)
), words as (select lang, cast(sum(len(ws)) as bigint) as n from p group by 1
), g as materialized (
  select lang, ws[i:i + k - 1] as ph, count(*) as f from (select lang, k, ws, unnest(range(1, len(ws) - k + 2)) as i from p, (select unnest(range(1, {spec.longest + 1})) as k) where len(ws) >= k) group by 1, 2 having count(*) >= {spec.least}
), cand as (select lang, ph, f as a, len(ph) as k from g where len(ph) > 1
), cuts as (
  select c.lang, c.ph, c.a, j, x.f as l, y.f as r, cast((cast({spec.scale} as hugeint) * c.a) // (x.f + y.f) as bigint) as score
  from (select *, unnest(range(1, k)) as j from cand) c join g x on x.lang = c.lang and x.ph = c.ph[1:j] join g y on y.lang = c.lang and y.ph = c.ph[j + 1:]
), best as (select * from cuts qualify row_number() over (partition by lang, ph order by score, j) = 1
), inner_ph as (
  select lang, ph[i:i + m - 1] as ph, max(a) as longer from (select lang, ph, a, k, m, unnest(range(1, k - m + 2)) as i from cand, (select unnest(range(2, {spec.longest})) as m) where m < k) group by 1, 2
), kept as (select best.* from best left join inner_ph using (lang, ph) where longer is null or 100 * cast(longer as hugeint) < {spec.inside} * cast(a as hugeint)
), ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) as rank, array_to_string(ph, ' ') as phrase, a, l, r, score from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join words using (lang) where rank <= {spec.top}"""
