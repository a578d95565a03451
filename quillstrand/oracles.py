"""SQL for the catalog's queries that takes more than a few lines: Huffman books, feedback and spline prediction."""

from __future__ import annotations

from .operators.spline import level_bound


def huffman(hist: str, name: str) -> str:
    """Expressions for the canonical book of a table hist (symbol, n): name (symbol, length, code).

    The two least of all nodes, by weight and then by least symbol, become one
    until one is left; a symbol's length is the number of nodes it went into.
    """
    both = "list_concat(nodes[1].held, nodes[2].held)"
    return f"""{name}_tree(nodes) as (
  select list_sort(list({{'n': cast(n as bigint), 's': cast(symbol as integer), 'held': [{{'c': cast(symbol as integer), 'd': 0}}]}})) from {hist} where n > 0
  union all select list_sort(list_append(nodes[3:], {{'n': nodes[1].n + nodes[2].n, 's': least(nodes[1].s, nodes[2].s), 'held': list_transform({both}, lambda q: {{'c': q.c, 'd': q.d + 1}})}})) from {name}_tree where len(nodes) > 1),
{name}_lengths as (select h.c as symbol, greatest(h.d, 1) as length from (select unnest(nodes[1].held) as h from {name}_tree where len(nodes) = 1)),
{name}_first(length, low) as (
  select max(length), cast(0 as bigint) from {name}_lengths
  union all select f.length - 1, (f.low + (select count(*) from {name}_lengths l where l.length = f.length) + 1) // 2 from {name}_first f where f.length > 1),
{name} as (select symbol, length, cast(low + row_number() over (partition by length order by symbol) - 1 as bigint) as code from {name}_lengths join {name}_first using (length))"""


def package_merge(hist: str, most: int) -> str:
    """Expressions for the least cost of a code of at most `most` bits for a table hist (symbol, n): pm_cost (n, cost)."""
    return f"""pm_own as (select list_sort(list(cast(n as bigint))) as own from {hist} where n > 0),
pm(level, items) as (
  select 1, own from pm_own
  union all select level + 1, list_sort(list_concat(own, list_transform(range(1, len(items) // 2 + 1), lambda i: items[2 * i - 1] + items[2 * i]))) from pm, pm_own where level < {most}),
pm_cost as (select cast(len(own) as bigint) as n, cast(list_sum(items[1:2 * len(own) - 2]) as bigint) as cost from pm, pm_own where level = {most})"""


def feedback(cells: str, sides: tuple[int, ...], eb: float, radius: int, name: str) -> str:
    """Expressions for feedback prediction of cells (x, ..., value) in blocks of `sides`: name (x, ..., code, restored), a cell of all blocks at a time."""
    axes = ("x", "y", "z")[: len(sides)]
    tiles = ", ".join(f"{a} // {n} as t{a}" for a, n in zip(axes, sides, strict=True))
    place, step = [], 1
    for a, n in zip(reversed(axes), reversed(sides), strict=True):
        place.append((f"({a} % {n})", step))
        step *= n
    strides = {a: s for (_, s), a in zip(place, reversed(axes), strict=True)}
    pos = " + ".join(f"{c} * {s}" for c, s in place)
    near = []
    for m in range(1, 1 << len(sides)):
        some = [a for k, a in enumerate(axes) if m >> k & 1]
        inside = " and ".join(f"(f.pos // {strides[a]}) % {n} > 0" for a, n in zip(axes, sides, strict=True) if a in some)
        back = sum(strides[a] for a in some)
        near.append(("-" if len(some) % 2 == 0 else "+") + f" case when {inside} then f.done[f.pos + 1 - {back}] else 0.0 end")
    pred = "0.0 " + " ".join(near)
    # a cell that the array does not have holds zero and is met by none that it has
    return f"""{name}_cells as materialized (select *, {tiles}, {pos} as pos from {cells}),
{name}_tiles as materialized (select {", ".join("t" + a for a in axes)}, list(pos order by pos) as ps, list(value order by pos) as vs from {name}_cells group by all),
{name}_dense as materialized (select * exclude (ps, vs), list_transform(range({step}), lambda p: coalesce(vs[list_position(ps, p)], 0.0)) as v from {name}_tiles),
{name}_run({", ".join("t" + a for a in axes)}, v, pos, done, codes) as (
  select *, 0, cast([] as double[]), cast([] as bigint[]) from {name}_dense
  union all select {", ".join("t" + a for a in axes)}, v, pos + 1, list_append(done, case when code <> 0 then pred + (code - {radius}) * 2 * cast({eb!r} as double) else v[pos + 1] end), list_append(codes, code)
  from (select *, case when floor(abs(steps) + 0.5) < {radius} then cast(floor(abs(steps) + 0.5) * (case when steps >= 0 then 1 else -1 end) as bigint) + {radius} else 0 end as code
    from (select *, (v[pos + 1] - pred) / (2 * cast({eb!r} as double)) as steps from (select f.*, {pred} as pred from {name}_run f where f.pos < {step})))),
{name} as (select c.{", c.".join(axes)}, codes[c.pos + 1] as code, done[c.pos + 1] as restored from {name}_cells c join {name}_run r on r.pos = {step} and {" and ".join(f"c.t{a} = r.t{a}" for a in axes)})"""


def wavefront2d(cells: str, eb: float, radius: int, name: str) -> str:
    """Expressions for feedback prediction over a whole 2-D array (x, y, value): name (x, y, code, restored), an anti-diagonal at a time."""
    code = f"case when floor(abs(s) + 0.5) < {radius} then cast(floor(abs(s) + 0.5) * (case when s >= 0 then 1 else -1 end) as bigint) + {radius} else 0 end"
    cell = f"select d, x, y, code, case when code <> 0 then pred + (code - {radius}) * 2 * cast({eb!r} as double) else value end as restored, 0 as age from (select *, {code} as code from (select *, (value - pred) / (2 * cast({eb!r} as double)) as s from"
    return f"""{name}_steps(d, x, y, code, restored, age) as (
  {cell} (select 0 as d, x, y, value, 0.0 as pred from {cells} where x = 0 and y = 0)))
  union all ({cell} (select n.d as d, c.x, c.y, c.value, 0.0 + coalesce(l.restored, 0.0) + coalesce(u.restored, 0.0) - coalesce(e.restored, 0.0) as pred
      from (select max(d) + 1 as d from {name}_steps) n join {cells} c on c.x + c.y = n.d
      left join {name}_steps l on l.age = 0 and l.x = c.x - 1 and l.y = c.y left join {name}_steps u on u.age = 0 and u.x = c.x and u.y = c.y - 1
      left join {name}_steps e on e.age = 1 and e.x = c.x - 1 and e.y = c.y - 1)))
    union all select d + 1, x, y, code, restored, 1 from {name}_steps where age = 0 and d < (select max(x + y) from {cells}))),
{name} as (select x, y, code, restored from {name}_steps where age = 0)"""


def spline(cells: str, sizes: tuple[str, str, str], eb: float, radius: int, name: str) -> str:
    """Expressions for spline prediction of cells (x, y, z, value): name (x, y, z, value, code, restored).

    sizes: SQL for the known length of a cell's block along x, y and z; sides are 8 along y and z, and x is one block.
    """
    side = {"x": 32, "y": 8, "z": 8}
    out = [f"{name}_0 as materialized (select *, cast({radius} as bigint) as code, value as restored from {cells} where x % 8 = 0 and y % 8 = 0 and z % 8 = 0)"]
    done, k = {"x": 8, "y": 8, "z": 8}, 0
    for unit in (4, 2, 1):
        bound = f"cast({level_bound(eb, unit)!r} as double)"
        for axis, size in (("z", sizes[2]), ("y", sizes[1]), ("x", sizes[0])):
            rest = [a for a in "xyz" if a != axis]
            grid = " and ".join([f"{axis} % {2 * unit} = {unit}", *(f"{a} % {done[a]} = 0" for a in rest)])
            joins = " ".join(f"left join {name}_{k} {alias} on {alias}.{axis} = c.{axis} + {off} and {' and '.join(f'{alias}.{a} = c.{a}' for a in rest)}" for alias, off in (("a3", -3 * unit), ("a1", -unit), ("b1", unit), ("b3", 3 * unit)))
            at = f"(c.{axis} % {side[axis]})"
            far, near = f"{at} - {3 * unit} >= 0", f"{at} + {3 * unit} < {size}"
            a3, a1, b1, b3 = (f"{x}.restored" for x in ("a3", "a1", "b1", "b3"))
            pred = f"case when {at} + {unit} >= {size} then {a1} when {far} and {near} then (-{a3} + 9 * {a1} + 9 * {b1} - {b3}) / 16 when {near} then (3 * {a1} + 6 * {b1} - {b3}) / 8 when {far} then (-{a3} + 6 * {a1} + 3 * {b1}) / 8 else ({a1} + {b1}) / 2 end"
            out.append(f"""{name}_{k + 1} as materialized (select * from {name}_{k} union all
  select x, y, z, value, case when inside then cast(steps as bigint) + {radius} else 0 end, case when inside then pred + steps * 2 * {bound} else value end
  from (select *, steps + {radius} >= 0 and steps + {radius} < {2 * radius} as inside from (select *, trunc((case when value - pred < 0 then -1 else 1 end) * (abs(value - pred) / {bound} + 1) / 2) as steps
    from (select c.x, c.y, c.z, c.value, {pred} as pred from {cells} c {joins} where {" and ".join(g if g.startswith("(") else "c." + g for g in grid.split(" and "))}))))""")
            done[axis] = unit
            k += 1
    return ",\n".join([*out, f"{name} as (select * from {name}_{k})"])
