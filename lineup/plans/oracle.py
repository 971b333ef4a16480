"""The same results in plain SQL, for checking.

Each fragment is one named table expression; ``query`` puts the fragments a
statement mentions in front of it. The SQL lists and ranks pools outright, so it
shares no shortcut with the Spark plans.
"""

from __future__ import annotations

import re

from ..functions import names, text
from ..functions.hashing import PAIR_FACTORS
from .views import REPLIES

TABLES: dict[str, str] = {}


def okey(purpose: str, *cols: str) -> str:
    return f"md5(concat_ws('|', {', '.join(['42', repr(purpose), *cols])}))"


def hint(lo: str, hi: str, purpose: str, *cols: str) -> str:
    return f"({lo} + {hbits(purpose, *cols)} % (({hi}) - ({lo}) + 1))"


def hbits(purpose: str, *cols: str) -> str:
    return f"('0x' || substr({okey(purpose, *cols)}, 1, 15))::BIGINT"


def pair_key(a: str, b: str) -> str:
    """Key of a pair of 60-bit values, by wide arithmetic reduced to 64 bits."""
    first = f"((({a})::HUGEINT + ({b})) * {PAIR_FACTORS[0]} % 18446744073709551616)::UBIGINT"
    mixed = f"xor({first}, {first} >> 32)"
    return f"(({mixed}::HUGEINT * {PAIR_FACTORS[1]} % 18446744073709551616)::UBIGINT >> 4)::BIGINT"


def four_draws(rows: str, n: str, purpose: str, key: str, name: str) -> str:
    """``rows`` four times, with different positions below ``n``: each draw is moved
    past the earlier ones in ascending order."""
    drawn = ", ".join(f"{hint('0', f'{n} - 1 - {j}', purpose, key, str(j))} AS d{j}" for j in range(4))
    moved = "list_reduce(list_sort([{}]), lambda x, t: x + (x >= t)::BIGINT, {})"
    return f"""
WITH d AS (SELECT *, {drawn} FROM {rows}),
two AS (SELECT *, d0 AS x0, d1 + (d1 >= d0)::BIGINT AS x1 FROM d),
three AS (SELECT *, {moved.format('x0, x1', 'd2')} AS x2 FROM two),
four AS (SELECT *, {moved.format('x0, x1, x2', 'd3')} AS x3 FROM three)
SELECT * EXCLUDE (d0, d1, d2, d3, x0, x1, x2, x3), unnest([x0, x1, x2, x3]) AS {name} FROM four"""


def query(final: str) -> str:
    """``final`` preceded by every fragment it needs."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", body):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    parts = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in needed)
    return f"WITH {parts}\nSELECT * FROM ({final})"


def variant(suffix: str, items: str) -> None:
    """Add every fragment over ``v_items`` once more, as ``name__suffix`` over other items."""
    over = {"v_items"}
    grown = True
    while grown:
        found = {
            name for name, body in TABLES.items()
            if "__" not in name and any(re.search(rf"\b{n}\b", body) for n in over)
        }
        grown = not found <= over
        over |= found
    pattern = re.compile(r"\b(" + "|".join(sorted(over, key=len, reverse=True)) + r")\b")
    for name in sorted(over - {"v_items"}):
        TABLES[f"{name}__{suffix}"] = pattern.sub(rf"\1__{suffix}", TABLES[name])
    TABLES[f"v_items__{suffix}"] = items


TABLES["v_kind"] = """
SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2
               WHEN 'signup' THEN 3 ELSE 4 END AS kind_no FROM events"""

TABLES["v_items"] = """
SELECT event_id AS item_id,
       (user_id // 6) * 3 + CASE WHEN user_id % 6 = 0 THEN 0 WHEN user_id % 6 <= 2 THEN 1 ELSE 2 END AS group_id,
       user_id AS entity_id,
       CASE WHEN (user_id // 6) % 2 = 1 OR ((user_id // 2) + kind_no) % 3 = 0 THEN kind_no
            ELSE user_id % 6 + 5 END AS source_id,
       CASE WHEN event_id % 5 = 0 THEN 'query' ELSE 'gallery' END AS role,
       CASE WHEN (event_id // 5) % 2 = 0 THEN 'same' ELSE 'cross' END AS corpus,
       event_id % (SELECT count(*) FROM embeddings) AS vec_id, ts, value
FROM v_kind"""

TABLES["v_paths"] = """
SELECT item_id, role, corpus,
       concat('/data/', corpus, '/10', group_id, '_20_', entity_id, '_CAM', source_id, '_EV', item_id,
              '_', lpad((item_id % 1000)::VARCHAR, 6, '0'), '_000.jpg') AS path
FROM v_items"""

TABLES["v_sizes"] = """
SELECT corpus, group_id, count(DISTINCT entity_id) AS family_size FROM v_items GROUP BY ALL"""

TABLES["v_owners"] = "SELECT DISTINCT item_id, group_id, vec_id FROM v_items"

TABLES["v_both"] = """
SELECT corpus, group_id, entity_id, source_id, count(*) AS n_both FROM (
  SELECT corpus, group_id, entity_id, source_id, item_id FROM v_items GROUP BY ALL HAVING count(DISTINCT role) > 1) GROUP BY ALL"""

TABLES["v_cells"] = """
SELECT corpus, group_id, entity_id, source_id, count(*) FILTER (role = 'query') AS n_query,
       count(*) FILTER (role = 'gallery') AS n_gallery
FROM v_items GROUP BY ALL"""

TABLES["v_tiers"] = """
SELECT g.group_id, g.family_size,
       CASE WHEN g.family_size <= 1 THEN 'tier3' WHEN s.group_id IS NOT NULL THEN 'tier1' ELSE 'tier2' END AS tier
FROM (SELECT group_id, count(DISTINCT entity_id) AS family_size FROM v_items GROUP BY 1) g
LEFT JOIN (SELECT DISTINCT group_id FROM (
             SELECT corpus, group_id, source_id FROM v_items WHERE role = 'gallery'
             GROUP BY ALL HAVING count(DISTINCT entity_id) >= 2)) s USING (group_id)"""

TABLES["v_split"] = f"""
SELECT group_id, tier,
       CASE WHEN row_number() OVER (PARTITION BY tier ORDER BY {okey('split', 'group_id')}, group_id)
                 <= CASE tier WHEN 'tier1' THEN 30 WHEN 'tier2' THEN 15 ELSE 70 END
            THEN 'test' ELSE 'train' END AS split
FROM v_tiers"""

# Every member is compared with every triple, as the definition says.
TABLES["v_triples"] = """
SELECT t.corpus, t.group_id, t.entity_id, t.source_id, c.camera, s.family_size,
       CASE WHEN s.family_size = 1 THEN 'singleton' ELSE 'family' END AS group_kind
FROM (SELECT * FROM v_cells LEFT JOIN v_both USING (corpus, group_id, entity_id, source_id) WHERE n_query > 0) t
CROSS JOIN (VALUES ('same'), ('cross')) c(camera)
JOIN v_sizes s USING (corpus, group_id)
JOIN (SELECT * FROM v_cells WHERE n_gallery > 0) m
  ON m.corpus = t.corpus AND m.group_id = t.group_id
 AND ((c.camera = 'same' AND m.source_id = t.source_id) OR (c.camera = 'cross' AND m.source_id <> t.source_id))
WHERE c.camera = 'cross' OR t.n_gallery <> 1 OR coalesce(t.n_both, 0) <> t.n_query
GROUP BY ALL HAVING count(DISTINCT m.entity_id) = s.family_size"""

TABLES["v_named"] = """
SELECT *, concat('cropped_', corpus, 'clothes_', group_kind, '_', camera, 'camera') AS scenario FROM v_triples"""

_TRIPLE_ORDER = f"{okey('triple', 'scenario', 'entity_id', 'source_id')}, concat_ws('|', entity_id, source_id)"

TABLES["v_requests"] = f"""
SELECT *, concat_ws('|', scenario, entity_id, source_id, draw) AS case_id FROM (
  SELECT corpus, group_id, entity_id, source_id, camera, family_size, scenario, 0 AS draw FROM v_named
  UNION ALL
  SELECT corpus, group_id, entity_id, source_id, camera, family_size, r.scenario, d.draw
  FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {_TRIPLE_ORDER}) - 1 AS rank FROM v_named) r
  JOIN (SELECT scenario, draw, {hint('0', 'n - 1', 'redraw', 'scenario', 'draw')} AS rank
        FROM (SELECT scenario, n, unnest(range(1, 151 - n)) AS draw
              FROM (SELECT scenario, count(*) AS n FROM v_named GROUP BY 1) WHERE n < 150)) d
    ON d.scenario = r.scenario AND d.rank = r.rank)"""

TABLES["v_sampled"] = f"""
WITH per AS (SELECT scenario, entity_id, count(*) AS n FROM v_named GROUP BY ALL),
chosen AS (SELECT *, count(*) OVER (PARTITION BY scenario) AS taken FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {okey('sample', 'scenario', 'entity_id')}, entity_id) AS turn
  FROM per) WHERE turn <= 50),
draws AS (SELECT scenario, entity_id, n, unnest(range(1, 1 + 150 // taken + CASE WHEN turn - 1 < 150 % taken THEN 1 ELSE 0 END)) AS draw
          FROM chosen)
SELECT t.corpus, t.group_id, t.entity_id, t.source_id, t.camera, t.family_size, t.scenario, d.draw,
       concat_ws('|', t.scenario, t.entity_id, d.draw) AS case_id
FROM (SELECT *, row_number() OVER (PARTITION BY scenario, entity_id ORDER BY {okey('source', 'source_id')}, source_id) - 1 AS rank
      FROM v_named) t
JOIN draws d ON d.scenario = t.scenario AND d.entity_id = t.entity_id
 AND t.rank = {hint('0', 'd.n - 1', 'draw', 'd.scenario', 'd.entity_id', 'd.draw')}"""

TABLES["v_vecs"] = """
SELECT i.item_id, i.group_id, i.vec_id, e.embedding::DOUBLE[] AS vec
FROM v_items i JOIN embeddings e ON e.vec_id = i.vec_id"""

TABLES["v_sims"] = """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS sim
FROM embeddings a CROSS JOIN embeddings b"""


def known(requests: str, merged: bool = False, whole: bool = True, diverse: bool = False,
          max_gallery: int = 5, source: str = "v_items") -> dict[str, str]:
    """Fragments that build known cases from a request table."""
    r = requests
    query_role = "gallery" if merged else "query"
    pick = (
        f"(row_number() OVER (PARTITION BY r.corpus, r.entity_id, r.source_id ORDER BY {okey('turn', 'r.case_id')}, r.case_id) - 1) % q.n"
        if diverse else hint("0", "q.n - 1", "query", "r.case_id")
    )
    turn = (
        f"(turn - 1) % n" if diverse else hint("0", "n - 1", "member", "case_id", "member_id")
    )
    size = "family_size" if whole else "1"
    return {
        f"{r}_p": f"""
SELECT r.case_id, r.scenario, r.corpus, r.group_id, r.entity_id, r.source_id, r.camera, {size} AS natural_size, q.item_id AS query_id
FROM (SELECT r.*, q.n, {pick} AS idx FROM {r} r
      JOIN (SELECT corpus, entity_id, source_id, count(*) AS n FROM {source} WHERE role = '{query_role}' GROUP BY ALL) q
        USING (corpus, entity_id, source_id)) r
JOIN (SELECT *, row_number() OVER (PARTITION BY corpus, entity_id, source_id ORDER BY {okey('item', 'item_id')}, item_id) - 1 AS idx
      FROM {source} WHERE role = '{query_role}') q
  ON q.corpus = r.corpus AND q.entity_id = r.entity_id AND q.source_id = r.source_id AND q.idx = r.idx""",
        # A case of which a member has no item left is no case.
        f"{r}_q": f"""
SELECT p.* FROM {r}_p p JOIN (
  SELECT case_id FROM {r}_o JOIN {r}_p USING (case_id) GROUP BY case_id HAVING count(DISTINCT member_id) = any_value(natural_size)) USING (case_id)""",
        f"{r}_o": f"""
  SELECT q.case_id, q.camera, q.source_id AS asked, q.entity_id, g.corpus, g.entity_id AS member_id, g.item_id, g.source_id
  FROM {r}_p q JOIN {source} g ON g.corpus = q.corpus AND g.group_id = q.group_id AND g.role = 'gallery'
   AND ((q.camera = 'same' AND g.source_id = q.source_id) OR (q.camera = 'cross' AND g.source_id <> q.source_id))
   AND g.item_id <> q.query_id {'' if whole else 'AND g.entity_id = q.entity_id'}""",
        f"{r}_m": f"""
WITH options AS (SELECT o.* FROM {r}_o o JOIN {r}_q USING (case_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY case_id, member_id ORDER BY {okey('source', 'source_id')}, source_id, {okey('item', 'item_id')}, item_id) - 1 AS idx,
         count(*) OVER (PARTITION BY case_id, member_id) AS n FROM options),
turns AS (
  SELECT case_id, member_id, n, row_number() OVER (PARTITION BY corpus, member_id, camera, asked ORDER BY {okey('turn', 'case_id')}, case_id) AS turn
  FROM (SELECT DISTINCT case_id, member_id, n, corpus, camera, asked FROM placed)),
picks AS (SELECT case_id, member_id, {turn} AS idx FROM turns)
SELECT p.case_id, p.item_id, CASE WHEN p.member_id = p.entity_id THEN 'own' ELSE 'member' END AS kind
FROM placed p JOIN picks k ON k.case_id = p.case_id AND k.member_id = p.member_id AND k.idx = p.idx""",
        **padding(r, "natural_size", max_gallery, ""),
    }


def padding(r: str, size: str, max_gallery: int, exclude: str) -> dict[str, str]:
    """Hard negatives for ``{r}_q`` and the finished slots of ``{r}_m``."""
    return {
        f"{r}_n": f"""
WITH ids AS (SELECT DISTINCT query_id FROM {r}_q),
firsts AS (
  SELECT i.query_id, c.group_id, arg_min(c.item_id, (-s.sim, c.item_id)) AS item_id, min((-s.sim, c.item_id)) AS rank
  FROM ids i JOIN v_owners a ON a.item_id = i.query_id JOIN v_sims s ON s.a = a.vec_id JOIN v_owners c ON c.vec_id = s.b
  WHERE c.group_id <> a.group_id GROUP BY ALL),
wanted AS (
  SELECT *, {hint(size, f'greatest({size}, {max_gallery})', 'target', 'case_id')} - {size} AS n_pad FROM {r}_q),
pooled AS (
  SELECT w.case_id, w.n_pad, f.item_id, row_number() OVER (PARTITION BY w.case_id ORDER BY f.rank) AS place
  FROM wanted w JOIN firsts f ON f.query_id = w.query_id {exclude} WHERE w.n_pad > 0),
taken AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {okey('negative', 'case_id', 'item_id')}, item_id) AS turn
  FROM pooled WHERE place <= greatest(n_pad, 10))
SELECT case_id, item_id, 'negative' AS kind FROM taken WHERE turn <= n_pad""",
        f"{r}_s": shuffled(f"SELECT * FROM {r}_m UNION ALL SELECT * FROM {r}_n", f"{r}_q"),
    }


def shuffled(slots: str, cases: str) -> str:
    return f"""
SELECT *, coalesce(max(CASE WHEN kind = 'own' THEN pos END) OVER (PARTITION BY case_id), -1) AS label,
       count(*) OVER (PARTITION BY case_id) AS n_gallery
FROM (SELECT s.case_id, q.scenario, q.query_id, s.item_id, s.kind,
             row_number() OVER (PARTITION BY s.case_id ORDER BY {okey('shuffle', 's.case_id', 's.item_id')}, s.item_id) AS pos
      FROM ({slots}) s JOIN (SELECT DISTINCT case_id, scenario, query_id FROM {cases}) q USING (case_id))"""


def strangers(requests: str, source: str = "v_items") -> str:
    """Stranger query per request, by listing the pool outside its group."""
    return f"""
WITH pool AS (
  SELECT *, concat_ws('|', corpus, item_id) AS pool_key FROM {source} WHERE role = 'query'),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY {okey('strangers', 'group_id')}, group_id, {okey('strangers', 'pool_key')}, pool_key) - 1 AS pos,
         count(*) OVER () AS total FROM pool),
own AS (SELECT group_id, count(*) AS n, min(pos) AS first FROM ordered GROUP BY 1),
drawn AS (
  SELECT r.*, {hint('0', '(SELECT count(*) FROM pool) - coalesce(o.n, 0) - 1', 'stranger', 'r.case_id')} AS i,
         coalesce(o.n, 0) AS n, coalesce(o.first, 0) AS first
  FROM {requests} r LEFT JOIN own o USING (group_id))
SELECT d.* EXCLUDE (i, n, first), p.item_id AS query_id, p.group_id AS stranger_group
FROM drawn d JOIN ordered p ON p.pos = d.i + CASE WHEN d.i >= d.first THEN d.n ELSE 0 END"""


def singleton(requests: str, max_gallery: int = 5, source: str = "v_items") -> dict[str, str]:
    r = requests
    return {
        f"{r}_q": strangers(r, source),
        f"{r}_s": shuffled(f"""
SELECT case_id, item_id, 'resident' AS kind FROM (
  SELECT q.case_id, g.item_id, row_number() OVER (PARTITION BY q.case_id ORDER BY s.sim DESC, g.item_id) AS rank,
         {hint('1', str(max_gallery), 'target', 'q.case_id')} AS target
  FROM {r}_q q JOIN v_owners a ON a.item_id = q.query_id
  JOIN {source} g ON g.corpus = q.corpus AND g.entity_id = q.entity_id AND g.role = 'gallery'
  JOIN v_sims s ON s.a = a.vec_id AND s.b = g.vec_id) WHERE rank <= target""", f"{r}_q"),
    }


def family(requests: str, max_gallery: int = 5, source: str = "v_items", diverse: bool = False) -> dict[str, str]:
    r = requests
    index = "(turn - 1) % n" if diverse else hint("0", "n - 1", "member", "case_id", "entity_id")
    return {
        f"{r}_q": f"""
SELECT q.*, m.natural_size FROM ({strangers(r, source)}) q
JOIN (SELECT corpus, group_id, count(DISTINCT entity_id) AS natural_size FROM {source} WHERE role = 'gallery' GROUP BY ALL) m
  USING (corpus, group_id)""",
        f"{r}_m": f"""
SELECT case_id, item_id, 'member' AS kind FROM (
  SELECT q.case_id, g.entity_id, g.item_id,
         row_number() OVER (PARTITION BY q.case_id, g.entity_id ORDER BY {okey('source', 'g.source_id')}, g.source_id, {okey('item', 'g.item_id')}, g.item_id) - 1 AS idx,
         count(*) OVER (PARTITION BY q.case_id, g.entity_id) AS n,
         dense_rank() OVER (PARTITION BY g.corpus, g.entity_id ORDER BY {okey('turn', 'q.case_id')}, q.case_id) AS turn
  FROM {r}_q q JOIN {source} g ON g.corpus = q.corpus AND g.group_id = q.group_id AND g.role = 'gallery')
WHERE idx = {index}""",
        **padding(r, "natural_size", max_gallery, "AND f.group_id <> w.group_id"),
    }


TABLES.update(known("v_requests"))
TABLES.update(known("v_sampled"))

TABLES["v_targets"] = """
SELECT s.corpus, s.group_id, s.family_size, o.entity_id FROM v_sizes s
JOIN (SELECT corpus, group_id, min(entity_id) AS entity_id FROM v_items WHERE role = 'gallery' GROUP BY ALL) o
  USING (corpus, group_id)"""

for _kind, _size in (("singleton", "= 1"), ("family", ">= 2")):
    TABLES[f"v_all_{_kind}"] = f"""
SELECT *, 'distractor_cropped_{_kind}' AS scenario, concat_ws('|', 'distractor_cropped_{_kind}', corpus, group_id) AS case_id
FROM v_targets WHERE family_size {_size}"""


def stratified(targets: str, scenario: str, total: str) -> str:
    return f"""
WITH sizes AS (SELECT family_size, count(*) AS n, row_number() OVER (ORDER BY family_size) - 1 AS turn,
                      count(*) OVER () AS k FROM {targets} GROUP BY 1),
shares AS (SELECT *, {total} // k + CASE WHEN turn >= k - {total} % k THEN 1 ELSE 0 END AS quota FROM sizes),
draws AS (SELECT family_size, n, unnest(range(1, quota + 1)) AS draw FROM shares)
SELECT t.*, d.draw, '{scenario}' AS scenario, concat_ws('|', '{scenario}', t.family_size, d.draw) AS case_id
FROM (SELECT *, row_number() OVER (PARTITION BY family_size ORDER BY {okey('targets', 'corpus', 'group_id')}, concat_ws('|', corpus, group_id)) - 1 AS rank
      FROM {targets}) t
JOIN draws d ON d.family_size = t.family_size
 AND t.rank = {hint('0', 'd.n - 1', 'target_group', repr(scenario), 'd.family_size', 'd.draw')}"""


for _kind, _size in (("singleton", "= 1"), ("family", ">= 2")):
    TABLES[f"v_t_{_kind}"] = f"SELECT * FROM v_targets WHERE family_size {_size}"
    TABLES[f"v_even_{_kind}"] = stratified(f"v_t_{_kind}", f"distractor_cropped_{_kind}", "200")

TABLES.update(singleton("v_all_singleton"))
TABLES.update(family("v_all_family"))
TABLES.update(singleton("v_even_singleton"))
TABLES.update(family("v_even_family"))

SLOT = "case_id, scenario, query_id, pos, item_id, kind, label, n_gallery"
TABLES["v_suite"] = f"""
SELECT {SLOT} FROM v_requests_s UNION ALL SELECT {SLOT} FROM v_all_singleton_s
UNION ALL SELECT {SLOT} FROM v_all_family_s"""
