"""SQL with the result of each registered query, for a check against another engine.

Counts of all attribute sets come from one GROUP BY CUBE over the whole table; FDs,
candidates and classes are derived from these counts.
"""

from __future__ import annotations

COLUMNS = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "benchmark": ["item_id", "text"],
    "pages": ["page_id", "url", "html"],
    "embeddings": ["vec_id", "embedding", "label"],
    "geo": ["c_custkey", "c_mktsegment", "n_nationkey", "n_name", "r_regionkey", "r_name", "src"],
    "gaps": ["c_custkey", "nation", "segment", "fourth", "c_acctbal"],
    "lineitem_supplier": [
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_suppkey", "s_name", "s_nationkey",
    ],
    "lineitem8": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        "l_returnflag", "l_linestatus",
    ],
}

GEO = """(select c_custkey, c_mktsegment, n_nationkey, n_name, r_regionkey, r_name, 1 as src
 from customer join nation on c_nationkey = n_nationkey
 join region on n_regionkey = r_regionkey)"""

GAPS = """(select c_custkey, nullif(c_nationkey, 5) nation, nullif(c_mktsegment, 'BUILDING') segment,
 nullif(c_nationkey % 4, 2) fourth, c_acctbal from customer)"""

SOURCE = {
    "geo": GEO, "lineitem8": "lineitem", "gaps": GAPS,
    "lineitem_supplier": "lineitem join supplier on l_suppkey = s_suppkey",
}


def _cube(name: str, max_size: int | None = None, columns: list[str] | None = None) -> str:
    """CTEs: ``n(mask, n)`` for all sets of columns, ``attr(i, b)`` and ``cnt(i, n)``.
    GROUPING gives its last argument the lowest bit, so the columns go in reverse."""
    columns = columns or COLUMNS[name]
    k = len(columns)
    cols = ", ".join(reversed(columns))
    if max_size is None:
        by = f"cube({cols})"
    else:
        sets = [
            "(" + ", ".join(c for i, c in enumerate(columns) if m >> i & 1) + ")"
            for m in range(1 << k) if m.bit_count() <= max_size
        ]
        by = f"grouping sets ({', '.join(sets)})"
    return f"""with sets as (select ({2 ** k - 1} - grouping({cols}))::bigint mask
 from {SOURCE.get(name, name)} group by {by}),
n as (select mask, count(*)::bigint n from sets group by mask),
attr as (select i::integer i, 1::bigint << (i - 1)::integer b from range(1, {k + 1}) r(i)),
cnt as (select i, b, n from attr join n on mask = b),
fd as (select x.mask lhs, a.i rhs, bit_count(x.mask)::integer level, x.n n_lhs, y.n n_all
 from n x join attr a on (x.mask & a.b) = 0 join n y on y.mask = (x.mask | a.b)),
holds as (select lhs, rhs, level from fd where n_lhs = n_all),
mn as (select * from holds x where not exists (select 1 from holds y
 where y.rhs = x.rhs and y.lhs <> x.lhs and (y.lhs & x.lhs) = y.lhs)),
cand as (select level, lhs, rhs from fd where lhs <> 0)"""


def _classes(name: str) -> str:
    """More CTEs: one-column FDs, classes and the reduced columns."""
    return _cube(name) + """,
single as (select x.i lhs, y.i rhs from cnt x join cnt y on x.i <> y.i and x.n > 1 and y.n > 1
 join n on mask = (x.b | y.b) where n.n = x.n),
cls as (select least(min(rhs), lhs) rep, lhs member from single s
 where exists (select 1 from single t where t.lhs = s.rhs and t.rhs = s.lhs) group by lhs),
oneway as (select lhs, rhs from single s
 where not exists (select 1 from single t where t.lhs = s.rhs and t.rhs = s.lhs)),
red as (select (row_number() over (order by i))::integer new_ord, i old_ord, n from cnt
 where n > 1 and i not in (select member from cls where member <> rep)),
restated as (select a.new_ord lhs, b.new_ord rhs from oneway o
 join red a on a.old_ord = o.lhs join red b on b.old_ord = o.rhs),
stands as (select new_ord, old_ord member from red
 union all select new_ord, member from red join cls on rep = old_ord and member <> rep),
rsets as (select s::bigint lhs, bit_count(s)::integer level from range(1, 128) t(s)
 where s < (1 << (select count(*) from red)::integer)),
rcand as (select level, lhs, new_ord rhs from rsets join red
 on (lhs & (1::bigint << (new_ord - 1))) = 0)"""


def _label(mask: str, k: int) -> str:
    parts = [f"case when ({mask} & {1 << (i - 1)}) <> 0 then 'column{i}' end" for i in range(1, k + 1)]
    return f"concat_ws(',', {', '.join(parts)})"


def _discovery(name: str, max_size: int | None = None, columns: list[str] | None = None) -> str:
    k = len(columns or COLUMNS[name])
    where = f" where level <= {max_size - 1}" if max_size else ""
    return (
        f"{_cube(name, max_size, columns)} select {_label('lhs', k)} lhs, 'column' || rhs rhs from mn{where}"
    )


def _text(name: str) -> str:
    k = len(COLUMNS[name])
    return (
        f"{_cube(name)} select '[' || {_label('lhs', k)} || ']:' || "
        f"string_agg('column' || rhs, ',' order by rhs) as \"value\" from mn group by lhs"
    )


def _as_words(name: str) -> str:
    return " union all ".join(f"select {c}::varchar word from {name}" for c in COLUMNS[name])


def _verdicts() -> str:
    """Per value of user_id: different left sides and left sides with a right side."""
    columns = COLUMNS["events"]
    parts = []
    for x in (1, 2, 4, 5, 6):
        for a in (1, 2, 4, 5, 6):
            if a == x:
                continue
            lhs, rhs = columns[x - 1], columns[a - 1]
            parts.append(
                f"select user_id as \"value\", {4 | 1 << (x - 1)}::bigint lhs, {a}::integer rhs,"
                f" count(distinct {lhs})::bigint n_lhs,"
                f" count(distinct struct_pack(x := {lhs}, a := {rhs}))::bigint n_all"
                f" from events group by user_id"
            )
    return " union all ".join(parts)


def _profile(name: str) -> str:
    return " union all ".join(
        f"select {i}::integer ordinal, '{c}' as name, count(*)::bigint n, sum(r)::bigint n_rows,"
        f" max(r)::bigint max_group, bool_or(v is null) has_null"
        f" from (select {c} v, count(*) r from {name} group by {c})"
        for i, c in enumerate(COLUMNS[name], 1)
    )


def oracle() -> dict[str, str]:
    orders, customer, part, events = (_cube(t) for t in ("orders", "customer", "part", "events"))
    geo = _classes("geo")
    votes = (
        f"with v as ({_verdicts()}) select lhs, rhs, count(*) filter (n_lhs = n_all)::bigint n_holding,"
        f" count(*)::bigint n_groups from v group by lhs, rhs"
    )
    lineitem_counts = " union all ".join(
        f"select {i}::integer ordinal, count(distinct {c})::bigint n from lineitem"
        for i, c in enumerate(COLUMNS["lineitem"], 1)
    )
    line = COLUMNS["lineitem"]
    pairs = " union all ".join(
        f"select {i + 1}::integer a, {j + 1}::integer b, count(*)::bigint n"
        f" from (select distinct {line[i]}, {line[j]} from lineitem)"
        for i in range(11) for j in range(i + 1, 11)
    )
    vocabulary = f"select word, count(*)::bigint n from ({_as_words('part')}) group by word"
    ids = f"select word, (row_number() over (order by word) - 1)::bigint id from ({vocabulary})"
    not_implied = (
        "select level, lhs, rhs from cand c where not exists (select 1 from holds h"
        " where h.lhs <> 0 and h.level <= {} and h.rhs = c.rhs and (h.lhs & c.lhs) = h.lhs)"
    )
    verdicts = _verdicts()
    sql = {
        "delimited_source": "select c_custkey::varchar c0, c_name c1, c_nationkey::varchar c2,"
        " c_acctbal::varchar c3, c_mktsegment c4 from customer",
        "split_lines_source": "select "
        + ", ".join(f"{c}::varchar c{i}" for i, c in enumerate(line[:10])) + " from lineitem",
        "staged_table": "select * from events",
        "fd_text_sink": _text("orders"),
        "project_by_number": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate from lineitem",
        "project_distinct": "select distinct l_partkey, l_suppkey, l_returnflag, l_linestatus"
        " from lineitem",
        "cast_all_columns": "select " + ", ".join(f"{c}::varchar {c}" for c in line) + " from lineitem",
        "numbered_integers": "select doc_id::integer c0, quality::integer c1, toxic::integer c2 from labels",
        "row_arrays": f"select concat_ws('|', {', '.join(COLUMNS['part'])}) cells from part",
        "composite_keys": "select l_partkey, l_suppkey, count(*)::bigint n from lineitem group by all",
        "split_cells": "select doc_id, len(string_split(text, ','))::bigint n_cells,"
        " string_split(text, ',')[-1] last_cell from documents",
        "joined_cells": f"select concat_ws(',', {', '.join(COLUMNS['customer'])}) as \"value\" from customer",
        "varying_columns": f"{geo} select i ordinal, n from cnt where n > 1",
        "set_functions": f"{orders} select lhs, rhs, lhs | (1::bigint << (rhs - 1)) with_rhs,"
        " lhs & ((1::bigint << (rhs - 1)) | 2) as shared, (63 - lhs)::bigint rest,"
        " (lhs & 2) <> 0 has_second, (lhs & 10) = 10 covers_two, level as size"
        " from holds where lhs <> 0 and level <= 2",
        "set_labels": f"{orders} select {_label('mask', 6)} cols, n from n where mask <> 0",
        "distinct_rows": "select distinct * from documents",
        "vocabulary": vocabulary,
        "fd_difference": f"{orders} select lhs, rhs from holds where level between 1 and 2",
        "fd_union": f"{orders} select lhs, rhs from holds where level between 1 and 3",
        "build_dictionary": ids,
        "dictionary_encoded": f"with d as ({ids}) select "
        + ", ".join(f"d{i}.id {c}" for i, c in enumerate(COLUMNS["part"]))
        + " from part "
        + " ".join(f"join d d{i} on d{i}.word = {c}::varchar" for i, c in enumerate(COLUMNS["part"])),
        "count_matches": f"{_classes('orders')} select lhs, rhs from single",
        "containment_join": f"{customer} {not_implied.format(2)}",
        "renumbered_pairs": f"{geo} select lhs, rhs from restated",
        "column_counts": lineitem_counts,
        "column_profile": _profile("lineitem"),
        "constant_columns": f"{geo} select i ordinal from cnt where n <= 1",
        "pair_counts": pairs,
        "set_count": "select count(*)::bigint n from (select distinct l_orderkey, l_linenumber, l_quantity from lineitem)",
        "set_counts": f"{orders} select mask, n from n where mask <> 0",
        "set_counts_in_one_scan": f"{orders} select mask, n from n where mask <> 0",
        "group_sizes": "select l_partkey as \"value\", count(*)::bigint n_rows from lineitem group by l_partkey",
        "group_count": "select count(distinct l_partkey)::bigint n_groups from lineitem",
        "group_verdicts": verdicts,
        "group_constancy": "select user_id as \"value\", bool_and(a) ok4, bool_and(b) ok6 from"
        " (select user_id, count(distinct event_type) = 1 a, count(distinct props) = 1 b"
        " from events group by user_id, value) group by user_id",
        "group_votes": votes,
        "violations": "select l_partkey, l_linenumber, count(distinct l_suppkey)::bigint n_rhs_values"
        " from lineitem group by all having count(distinct l_suppkey) > 1",
        "given_fds": " union all ".join(
            f"select '{lhs}' lhs, '{rhs}' rhs, (select count(*) from (select distinct {key} from orders))"
            f" = (select count(*) from (select distinct {key}, {rhs} from orders)) holds"
            for lhs, key, rhs in (
                ("o_orderkey", "o_orderkey", "o_custkey"),
                ("o_custkey", "o_custkey", "o_orderkey"),
                ("o_custkey,o_totalprice", "o_custkey, o_totalprice", "o_orderdate"),
                ("", "1", "o_orderstatus"),
            )
        ),
        "right_sides": f"{customer} select {_label('lhs', 5)} lhs,"
        " string_agg('column' || rhs, ',' order by rhs) rhs from mn group by mn.lhs",
        "ranked_columns": f"select ordinal, n, (row_number() over (order by n desc, ordinal))::integer"
        f" as position from ({lineitem_counts})",
        "class_representatives": f"{geo} select rep, max(n) n from cls join cnt on i = member group by rep",
        "line_widths": "select len(string_split(concat_ws(',', c_custkey, c_name, c_nationkey, c_acctbal,"
        " c_mktsegment), ','))::integer width, count(*)::bigint n_rows from customer group by all",
        "single_fds": f"{_classes('orders')} select lhs, rhs from single",
        "single_fds_ordered": f"{_classes('orders')} select lhs, rhs from single",
        "prove_by_counts": f"{customer} select lhs, rhs from holds where level = 2",
        "refute_by_counts": f"{customer} select lhs, rhs from fd where level = 2 and n_lhs <> n_all",
        "prove_by_groups": f"{events} select lhs, rhs from holds where level = 2 and (lhs & 4) <> 0",
        "refute_by_groups": f"{events} select lhs, rhs from fd where level = 2 and (lhs & 4) <> 0"
        " and n_lhs <> n_all",
        "grouped_test": f"{orders} select lhs, max(n_lhs) n_lhs, sum(case when n_lhs <> n_all"
        " then 1::bigint << (rhs - 1) else 0 end)::bigint refuted from fd where level = 1 group by lhs",
        "widest_candidates": f"{geo} select lhs, rhs from rcand"
        " where level = (select count(*) from red) - 1",
        "widest_fds": f"{part} select lhs, rhs from holds where level = 5",
        "widest_fds_by_groups": f"{part} select lhs, rhs from holds where level = 5",
        "equivalence_classes": f"{geo} select rep, member from cls",
        "one_way_fds": f"{geo} select lhs, rhs from oneway",
        "reduced_columns": f"{geo} select new_ord, old_ord, n from red",
        "restated_fds": f"{geo} select 1::bigint << (lhs - 1) lhs, rhs from restated",
        "substituted_left": f"{geo} select 'column' || member lhs, rhs from restated"
        " join stands on new_ord = lhs",
        "expanded_right": f"{geo} select 'column' || x.member lhs, 'column' || y.member rhs from restated"
        " join stands x on x.new_ord = lhs join stands y on y.new_ord = rhs",
        "class_fds": f"{geo} select 'column' || x.member lhs, 'column' || y.member rhs from cls x"
        " join cls y on x.rep = y.rep and x.member <> y.member",
        "constant_fds": f"{geo} select '' lhs, 'column' || i rhs from cnt where n <= 1",
        "constant_fds_expanded": f"{geo} select case when a.i = c.i then '' else 'column' || a.i end lhs,"
        " 'column' || c.i rhs from cnt c join attr a on true where c.n <= 1",
        "fd_text": _text("part"),
        "attribute_sets": f"{geo} select lhs, level from rsets",
        "all_candidates": f"{geo} select level, lhs, rhs from rcand",
        "inner_levels": f"{geo} select level, lhs, rhs from rcand"
        " where level not in (1, (select count(*) from red) - 1)",
        "level_sizes": f"{geo} select level, count(*)::bigint n from rcand group by level",
        "candidates_with_column": f"{part} {not_implied.format(1)} and level = 2 and (lhs & 4) <> 0",
        "candidates_inside": f"{part} {not_implied.format(1)} and ((lhs | (1::bigint << (rhs - 1))) & 22)"
        " = (lhs | (1::bigint << (rhs - 1)))",
        "candidates_not_implied": f"{orders} {not_implied.format(1)}",
        "candidates_not_refuted": f"{orders} select level, lhs, rhs from cand c where not exists"
        " (select 1 from fd f where f.level = 3 and f.n_lhs <> f.n_all and f.rhs = c.rhs"
        " and (f.lhs & c.lhs) = c.lhs)",
        "candidates_not_redundant": f"{orders} select level, lhs, rhs from cand c where not exists"
        " (select 1 from holds h where h.level = 1 and ((h.lhs | (1::bigint << (h.rhs - 1))) & c.lhs)"
        " = (h.lhs | (1::bigint << (h.rhs - 1))))",
        "fds_not_implied": f"{orders} select lhs, rhs from holds c where level = 3 and not exists"
        " (select 1 from holds h where h.level = 1 and h.rhs = c.rhs and (h.lhs & c.lhs) = h.lhs)",
        "minimal_fds": f"{orders} select lhs, rhs from mn where level >= 1",
        "maximal_failures": f"{orders} select lhs, rhs from fd x where lhs <> 0 and n_lhs <> n_all and not exists"
        " (select 1 from fd y where y.n_lhs <> y.n_all and y.rhs = x.rhs and y.lhs <> x.lhs"
        " and (y.lhs & x.lhs) = x.lhs)",
        "grown_failures": f"{orders} select f.lhs, f.rhs, c.lhs grown from fd f join cand c"
        " on c.rhs = f.rhs and c.level = 3 and (c.lhs & f.lhs) = f.lhs"
        " where f.level = 2 and f.n_lhs <> f.n_all",
        "next_level": f"{orders} select 3::integer level, f.lhs | a.b lhs, f.rhs from fd f join attr a"
        " on a.b > f.lhs and a.i <> f.rhs where f.level = 2 and f.n_lhs <> f.n_all",
        "known_in_groups": f"with v as ({verdicts}), bad as (select distinct lhs, rhs from v where n_lhs <> n_all),"
        " attr as (select i::integer i, 1::bigint << (i - 1)::integer b from range(1, 7) r(i))"
        " select distinct v.\"value\", v.lhs | a.b lhs, v.rhs from v join bad using (lhs, rhs)"
        " join attr a on (v.lhs & a.b) = 0 and a.i <> v.rhs where v.n_lhs = v.n_all",
        "discover_from_text": _text("orders"),
        "discover_by_count": _discovery("part"),
        "discover_in_parts": _discovery("part"),
        "discover_from_both_ends": _discovery("orders"),
        "discover_by_groups": _discovery("customer"),
        "discover_sliced": _discovery("orders"),
        "failing_groups": f'select "value", lhs, rhs from ({_verdicts()}) where n_lhs <> n_all',
        "discover_columns": _discovery("part", columns=COLUMNS["part"][1:]),
        "discover_geo_expanded": f"{geo} select {_label('lhs', 7)} lhs, 'column' || rhs rhs from mn"
        " union all select 'column' || a.i, 'column' || c.i from cnt c join attr a on a.i <> c.i where c.n <= 1",
        "discover_customer_as_text": _discovery("customer"),
        "discover_lineitem_up_to_3": _discovery("lineitem", 4),
    }
    for name in COLUMNS:
        sql[f"discover_{name}"] = _discovery(name)
    return sql
