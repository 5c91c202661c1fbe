"""Reference SQL (DuckDB) of the manifest: one group of common table expressions for each level."""

SOURCE_LEVELS, ROOT_LEVELS = 6, 3

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BYTE = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda r, z: xor(r >> 1, case when r & 1 = 1 then 3988292384 else 0 end))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: {_BYTE}), 4294967295)"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _fold(name: str, levels: int) -> list[str]:
    """Levels {name}0 (tree, pos, h, n) up to {name}{levels}, one node a tree, and their runs {name}run{k}."""
    out = []
    for k in range(levels):
        out.append(f"{name}run{k} as (select tree, pos // 16 as run, list(h order by pos) as hs, max(n) as n from {name}{k} group by tree, pos // 16)")
        out.append(
            f"{name}{k + 1} as (select tree, run as pos, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h,"
            f" (n + 15) // 16 as n from {name}run{k})"
        )
    return out


def _climb(name: str, levels: int, start: str) -> list[str]:
    """From table `start` (at_tree, spot, up, proof and others) through the runs of {name} to {name}c{levels}."""
    out, now = [], start
    for k in range(levels):
        sibling = "r.hs[: (c.spot % 16)::int] , r.hs[(c.spot % 16)::int + 2 :]"
        out.append(
            f"{name}c{k} as (select c.* replace (c.spot // 16 as spot,"
            f" case when r.n > 1 then c.proof || array_to_string(list_concat({sibling}), '') else c.proof end as proof,"
            f" case when r.n > 1 then sha256(array_to_string(r.hs[: (c.spot % 16)::int], '') || c.up || array_to_string(r.hs[(c.spot % 16)::int + 2 :], '')) else c.up end as up)"
            f" from {now} c join {name}run{k} r on r.tree = c.at_tree and r.run = c.spot // 16)"
        )
        now = f"{name}c{k}"
    return out


MANIFEST = ",\n".join(
    [
        f"with docs as (select doc_id, source, {_leaf('text')} as leaf, case when {_CRC} % 5 = 0 then {_leaf(_LOWER)} end as given from documents)",
        "placed as (select *, dense_rank() over (order by source nulls first) - 1 as tree,"
        " row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from docs)",
        "s0 as (select tree, pos, leaf as h, n from placed)",
        *_fold("s", SOURCE_LEVELS),
        f"t0 as (select 0 as tree, tree as pos, h, count(*) over () as n from s{SOURCE_LEVELS})",
        *_fold("t", ROOT_LEVELS),
        "start as (select doc_id, tree, leaf, tree as at_tree, pos as spot, coalesce(given, leaf) as up, '' as proof from placed)",
        *_climb("s", SOURCE_LEVELS, "start"),
        f"top as (select c.* replace (0 as at_tree, c.tree as spot) from sc{SOURCE_LEVELS - 1} c)",
        *_climb("t", ROOT_LEVELS, "top"),
    ]
) + f"""
select c.doc_id, c.leaf, s.h as subroot, r.h as root, sha256(c.proof) as proof_sha256, c.up as folded_root, c.up = r.h as verified
from tc{ROOT_LEVELS - 1} c join s{SOURCE_LEVELS} s on s.tree = c.tree cross join t{ROOT_LEVELS} r
"""
