"""The reconcile as DuckDB SQL, an independent form of operators/reconcile.py to hold its results against."""

from __future__ import annotations


def reconcile_ctes(proto: str, same_bar: float, cross_bar: float) -> str:
    """WITH RECURSIVE .. up to final (run_id, key, root) and ids (run_id, root, identity); proto are the CTEs up to p.

    Phase 1 walks through the pairs of a camera by descending score, with the groups as a list of
    roots by position; phase 2 repeats mutual best partners; ids are allotted cluster by cluster.
    """
    return f"""WITH RECURSIVE {proto},
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cam, track_id) - 1 AS key, row_number() OVER (PARTITION BY run_id, cam ORDER BY track_id) AS pos FROM p),
cl AS (SELECT run_id, cam, list(key ORDER BY pos) AS ks, count(*) AS m FROM k GROUP BY ALL),
col AS (SELECT x.run_id, x.cam, list({{'x': x.pos, 'y': y.pos}}) AS hits FROM k x JOIN k y ON x.run_id = y.run_id AND x.cam = y.cam AND x.pos <> y.pos AND NOT (x.last_frame < y.first_frame OR y.last_frame < x.first_frame) GROUP BY ALL),
pq AS (SELECT x.run_id, x.cam, x.pos AS a, y.pos AS b, row_number() OVER (PARTITION BY x.run_id, x.cam ORDER BY list_dot_product(x.proto, y.proto) DESC, x.pos DESC, y.pos DESC) AS n
  FROM k x JOIN k y ON x.run_id = y.run_id AND x.cam = y.cam AND x.pos < y.pos AND (x.last_frame < y.first_frame OR y.last_frame < x.first_frame) WHERE list_dot_product(x.proto, y.proto) >= {same_bar}),
g1 AS (SELECT run_id, cam, 0::BIGINT AS n, range(1, m + 1) AS roots FROM cl UNION ALL
  SELECT g1.run_id, g1.cam, pq.n, CASE WHEN g1.roots[pq.a] = g1.roots[pq.b] OR len(list_filter(coalesce(col.hits, []), lambda h: g1.roots[h.x] = g1.roots[pq.a] AND g1.roots[h.y] = g1.roots[pq.b])) > 0 THEN g1.roots
    ELSE list_transform(g1.roots, lambda r: CASE WHEN r = greatest(g1.roots[pq.a], g1.roots[pq.b]) THEN least(g1.roots[pq.a], g1.roots[pq.b]) ELSE r END) END
  FROM g1 JOIN pq ON pq.run_id = g1.run_id AND pq.cam = g1.cam AND pq.n = g1.n + 1 LEFT JOIN col ON col.run_id = g1.run_id AND col.cam = g1.cam),
l1 AS (SELECT * FROM g1 QUALIFY row_number() OVER (PARTITION BY run_id, cam ORDER BY n DESC) = 1),
ph1 AS (SELECT k.run_id, k.key, cl.ks[l1.roots[k.pos]] AS root FROM k JOIN l1 ON l1.run_id = k.run_id AND l1.cam = k.cam JOIN cl ON cl.run_id = k.run_id AND cl.cam = k.cam),
rounds AS (SELECT run_id, key, root, 0 AS it, NULL::DOUBLE AS ms FROM ph1 UNION ALL (
  WITH cur AS (SELECT r.run_id, r.key, r.root, r.it, r.ms, k.cam, k.first_frame, k.last_frame, k.proto FROM rounds r JOIN k ON k.run_id = r.run_id AND k.key = r.key),
  xs AS (SELECT run_id, root, unnest(proto) AS x, generate_subscripts(proto, 1) AS i FROM cur), sm AS (SELECT run_id, root, i, sum(x) AS x FROM xs GROUP BY ALL), w AS (SELECT run_id, root, list(x ORDER BY i) AS w FROM sm GROUP BY ALL),
  cm AS (SELECT run_id, root, list_distinct(list(cam)) AS cams FROM cur GROUP BY ALL), cx AS (SELECT w.run_id, w.root, w, sqrt(list_dot_product(w, w)) AS len_, cams FROM w JOIN cm ON cm.run_id = w.run_id AND cm.root = w.root),
  cf AS (SELECT DISTINCT x.run_id, x.root AS a, y.root AS b FROM cur x JOIN cur y ON x.run_id = y.run_id AND x.cam = y.cam AND x.root < y.root AND NOT (x.last_frame < y.first_frame OR y.last_frame < x.first_frame)),
  pr AS (SELECT x.run_id, x.root AS a, y.root AS b, list_dot_product(x.w, y.w) / (x.len_ * y.len_) AS s, len(list_intersect(x.cams, y.cams)) AS shared, len(x.cams) = 1 AND len(y.cams) = 1 AS single FROM cx x JOIN cx y ON x.run_id = y.run_id AND x.root < y.root),
  ed AS (SELECT pr.run_id, pr.a, pr.b, s FROM pr LEFT JOIN cf ON cf.run_id = pr.run_id AND cf.a = pr.a AND cf.b = pr.b WHERE cf.a IS NULL AND NOT (shared = 1 AND single) AND s >= CASE WHEN shared = 0 THEN {cross_bar} ELSE {max(same_bar, 0)} END),
  bo AS (SELECT run_id, a AS me, b AS you, s FROM ed UNION ALL SELECT run_id, b, a, s FROM ed), be AS (SELECT * FROM bo QUALIFY row_number() OVER (PARTITION BY run_id, me ORDER BY s DESC, you DESC) = 1),
  mv AS (SELECT x.run_id, x.you AS old, x.me AS fresh, x.s FROM be x JOIN be y ON y.run_id = x.run_id AND y.me = x.you AND y.you = x.me WHERE x.me < x.you)
  SELECT cur.run_id, cur.key, coalesce(mv.fresh, cur.root), cur.it + 1, coalesce(cur.ms, CASE WHEN cur.key = mv.old THEN mv.s END) FROM cur LEFT JOIN mv ON mv.run_id = cur.run_id AND mv.old = cur.root WHERE cur.run_id IN (SELECT run_id FROM mv))),
final AS (SELECT run_id, key, root, ms FROM rounds QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY it DESC) = 1),
gd AS (SELECT DISTINCT f.run_id, f.root, obs.gid FROM final f JOIN k ON k.run_id = f.run_id AND k.key = f.key JOIN obs ON obs.run_id = k.run_id AND obs.cam = k.cam AND obs.track_id = k.track_id WHERE obs.gid > 0),
cg AS (SELECT c.run_id, c.root, row_number() OVER (PARTITION BY c.run_id ORDER BY c.root) AS n, list(gid) FILTER (gid IS NOT NULL) AS gids FROM (SELECT DISTINCT run_id, root FROM final) c LEFT JOIN gd ON gd.run_id = c.run_id AND gd.root = c.root GROUP BY c.run_id, c.root),
tp AS (SELECT run_id, coalesce(max(gid), 0) AS top FROM obs GROUP BY run_id),
al AS (SELECT run_id, 0::BIGINT AS n, NULL::BIGINT AS root, NULL::BIGINT AS identity, []::BIGINT[] AS used, top + 1 AS fresh FROM tp UNION ALL
  SELECT q.run_id, q.n, q.root, coalesce(q.own, q.fresh), list_append(q.used, coalesce(q.own, q.fresh)), CASE WHEN q.own IS NULL THEN q.fresh + 1 ELSE q.fresh END
  FROM (SELECT cg.run_id, cg.n, cg.root, al.used, al.fresh, list_min(list_filter(coalesce(cg.gids, []), lambda g: NOT list_contains(al.used, g))) AS own FROM al JOIN cg ON cg.run_id = al.run_id AND cg.n = al.n + 1) q),
ids AS (SELECT run_id, root, identity FROM al WHERE n > 0),
ri AS (SELECT t.run_id, t.cam, t.track_id, CASE WHEN t.observations < 3 THEN 'suppressed' WHEN ids.identity IS NOT NULL THEN 'resolved' ELSE 'expired_unresolved' END AS state, ids.identity, f.root, t.observations, t.first_frame, t.last_frame
  FROM t LEFT JOIN k ON k.run_id = t.run_id AND k.cam = t.cam AND k.track_id = t.track_id LEFT JOIN final f ON f.run_id = k.run_id AND f.key = k.key LEFT JOIN ids ON ids.run_id = f.run_id AND ids.root = f.root)"""
