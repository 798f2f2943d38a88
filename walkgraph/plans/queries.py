"""Every operator as a query over the test tables, beside the SQL that gives the same rows.

The graph is the hand-off graph of `events` (see sources.views) unless a name says trade. Each
query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkgraph.config import EngineConfig, WalkConfig
from walkgraph.functions import rng, scalars
from walkgraph.operators import arbiter, events, graph, rank, setops, walks, walkstore
from walkgraph.operators.graph import GraphStore
from walkgraph.schemas import DEMOTION, EVENTS, PROMOTION
from walkgraph.sources import views
from walkgraph.streaming import pipeline

CONFIG = WalkConfig(alpha=0.85, walks_per_node=20, seed=42)
#: A fixed moment for ages and additions.
NOW = "2030-01-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EDGES = """e AS (
  SELECT DISTINCT src, dst FROM (
    SELECT user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND dst <> src)"""
NODES = """n AS (
  SELECT user_id AS id, md5(CAST(user_id AS VARCHAR)) AS pubkey,
         CASE WHEN user_id % 3 = 0 THEN 'active' ELSE 'inactive' END AS status, min(ts) AS added_ts
  FROM events GROUP BY user_id)"""
#: All users, and as many ids of which some are unknown.
ASKED = "q AS (SELECT user_id AS id FROM events UNION SELECT user_id + 7 FROM events)"
FOLLOWS = "f AS (SELECT src, list(dst ORDER BY dst) AS fs FROM e GROUP BY src)"
R, LIMIT = CONFIG.walks_per_node, rng.limit(CONFIG.alpha)


def _grown(name: str, start: str, follows: str, salt: int) -> str:
    """SQL of the table `name` (walk_id, path): the walks of `start` grown on by the lists of `follows`."""
    stop, pick = rng.draw_sql(CONFIG.seed, "walk_id", "k", salt)
    return f"""{name}_steps(walk_id, path, k) AS (
  SELECT walk_id, path, 1 FROM ({start})
  UNION ALL
  SELECT walk_id, list_append(path, dst), k + 1 FROM (
    SELECT walk_id, path, k, fs[{pick} % len(fs) + 1] AS dst FROM {name}_steps JOIN {follows} ON {follows}.src = path[-1]
    WHERE {stop} <= {LIMIT})
  WHERE NOT list_contains(path, dst)),
{name} AS (SELECT walk_id, arg_max(path, k) AS path FROM {name}_steps GROUP BY walk_id)"""


_GRAPH = f"{EDGES}, {NODES}, {FOLLOWS}"
_EVERY_WALK = _grown("walks", f"SELECT id * {R} + r AS walk_id, [id] AS path FROM n, range({R}) AS t(r)", "f", walks.GENERATE)
WALKS = f"{_GRAPH}, {_EVERY_WALK}, visits AS (SELECT walk_id, unnest(path) AS node FROM walks)"
EVENTS_SQL = f"""ev AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, md5(CAST(user_id AS VARCHAR)) AS pubkey,
         CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 0 ELSE 1 END AS kind,
         CAST(floor(epoch(ts)) AS BIGINT) AS created_at, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events),
newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, kind ORDER BY created_at DESC, id) AS rn FROM ev) WHERE rn = 1),
keys AS (
  SELECT DISTINCT newest.pubkey, newest.user_id, md5(CAST(x AS VARCHAR)) AS key
  FROM newest, unnest([k, (k * 7) % 100]) AS u(x) WHERE kind = 3 AND x <> user_id)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark, d):
    return views.handoff_edges(spark, d)


def _asked(spark, d):
    users = views.table(spark, d, "events").select(F.col("user_id").alias("id"))
    return users.unionByName(users.select((F.col("id") + 7).alias("id"))).distinct()


def _store(spark, d):
    """Nodes and edges, as yet without changes of status."""
    none = [F.lit(None).cast("timestamp").alias(c) for c in ("promotion_ts", "demotion_ts")]
    return GraphStore(views.nodes(spark, d).select("id", "pubkey", "status", "added_ts", *none), _edges(spark, d))


def _walks(spark, d):
    return walks.generate(views.nodes(spark, d), _edges(spark, d), CONFIG)


# Scans, lookups, counts


@query(f"WITH {NODES} SELECT id, pubkey, status FROM n")
def node_scan(spark, d):
    return _store(spark, d).scan(8).select("id", "pubkey", "status")


@query(f"WITH {NODES} SELECT count(*) AS n FROM n")
def node_size(spark, d):
    return graph.size(views.nodes(spark, d))


@query(f"WITH {NODES} SELECT id, pubkey, status FROM n WHERE pubkey = md5('7')")
def node_by_key(spark, d):
    return _store(spark, d).select(F.col("pubkey") == F.md5(F.lit("7"))).select("id", "pubkey", "status")


@query(f"WITH {NODES} SELECT id, pubkey, status FROM n WHERE id = 7")
def node_by_id(spark, d):
    return _store(spark, d).select(F.col("id") == 7).select("id", "pubkey", "status")


@query(f"WITH {NODES} SELECT id FROM n")
def all_nodes(spark, d):
    return _store(spark, d).all_nodes()


@query(f"WITH {NODES}, {ASKED} SELECT q.id, n.id IS NOT NULL AS found FROM q LEFT JOIN n USING (id)")
def contains_node(spark, d):
    return graph.contains(_asked(spark, d), views.nodes(spark, d))


@query(f"WITH {NODES}, {ASKED} SELECT q.id AS pos, md5(CAST(q.id AS VARCHAR)) AS pubkey, CAST(n.id AS VARCHAR) AS id FROM q LEFT JOIN n USING (id)")
def node_ids_lookup(spark, d):
    keys = _asked(spark, d).select(F.col("id").alias("pos"), F.md5(F.col("id").cast("string")).alias("pubkey"))
    return graph.node_ids(keys, views.nodes(spark, d)).withColumn("id", F.col("id").cast("string"))


@query(f"WITH {NODES}, {ASKED} SELECT q.id AS pos, q.id, n.pubkey FROM q LEFT JOIN n USING (id)")
def pubkeys_lookup(spark, d):
    return graph.pubkeys(_asked(spark, d).select(F.col("id").alias("pos"), "id"), views.nodes(spark, d))


@query(f"""WITH {EDGES}, {NODES}, {FOLLOWS}
SELECT id, coalesce(array_to_string(fs, ','), '') AS list FROM n LEFT JOIN f ON id = src""")
def follows(spark, d):
    out = graph.adjacency(views.nodes(spark, d).select("id"), _edges(spark, d))
    return out.withColumn("list", scalars.format_walk("list"))


@query(f"""WITH {EDGES}, {NODES}, g AS (SELECT dst, list(src ORDER BY src) AS fs FROM e GROUP BY dst)
SELECT id, coalesce(array_to_string(fs, ','), '') AS list FROM n LEFT JOIN g ON id = dst""")
def followers(spark, d):
    out = graph.adjacency(views.nodes(spark, d).select("id"), _edges(spark, d), "dst", "src")
    return out.withColumn("list", scalars.format_walk("list"))


@query(f"WITH {EDGES}, {ASKED} SELECT id, count(src) AS n FROM q LEFT JOIN e ON id = src GROUP BY id")
def follow_counts(spark, d):
    return graph.degrees(_asked(spark, d), _edges(spark, d))


@query(f"WITH {EDGES}, {ASKED} SELECT id, count(dst) AS n FROM q LEFT JOIN e ON id = dst GROUP BY id")
def follower_counts(spark, d):
    return graph.degrees(_asked(spark, d), _edges(spark, d), "dst")


@query(f"""WITH {NODES} SELECT id, CAST(floor(epoch(added_ts)) AS BIGINT) AS added,
CASE WHEN status = 'active' THEN CAST(CAST(floor(epoch(added_ts)) AS BIGINT) + 60 AS VARCHAR) END AS promoted, CAST(NULL AS VARCHAR) AS demoted FROM n""")
def node_records(spark, d):
    nodes = views.nodes(spark, d)
    later = F.when(F.col("status") == "active", F.col("added_ts") + F.expr("INTERVAL 60 SECONDS"))
    rows = graph.record_list(nodes.withColumn("promotion_ts", later).withColumn("demotion_ts", F.lit(None).cast("timestamp")))
    added, *others = [F.unix_seconds(graph.record("records", k)) for k in (-3, -2, -1)]
    return rows.select("id", added.alias("added"), *[x.cast("string").alias(c) for x, c in zip(others, ("promoted", "demoted"))])


@query(f"""WITH {NODES} SELECT id, pubkey, status, CAST(floor(epoch(added_ts)) AS BIGINT) AS added FROM n""")
def parse_node(spark, d):
    fields = F.create_map(
        F.lit("id"), F.col("id").cast("string"), F.lit("pubkey"), F.col("pubkey"), F.lit("status"), F.col("status"),
        F.lit("added_ts"), F.unix_seconds("added_ts").cast("string"), F.lit("other"), F.lit("x"))
    rows = views.nodes(spark, d).select(fields.alias("m")).select(graph.parse_node("m").alias("s"))
    return rows.select("s.id", "s.pubkey", "s.status", F.unix_seconds("s.added_ts").alias("added"))


# Sets of ids


@query("SELECT user_id AS id, array_to_string(list_sort(list_distinct(list(CAST(json_extract(props, '$.k') AS BIGINT)))), ',') AS ids FROM events GROUP BY user_id")
def unique_ids(spark, d):
    rows = views.events(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.collect_list("k").alias("ks"))
    return rows.select("id", scalars.format_walk(scalars.unique_sorted("ks")).alias("ids"))


_HALVES = """o AS (SELECT user_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type = 'view' AS v FROM events),
a AS (SELECT DISTINCT id, k FROM o WHERE v), b AS (SELECT DISTINCT id, k FROM o WHERE NOT v)"""


def _halves(spark, d):
    rows = views.events(spark, d)
    sides = [F.array_sort(F.collect_set(F.when(c, F.col("k")))) for c in (F.col("kind") == 3, F.col("kind") != 3)]
    return rows.groupBy(F.col("user_id").alias("node_id")).agg(sides[0].alias("old"), sides[1].alias("new"))


@query(f"""WITH {_HALVES}
SELECT id, coalesce((SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM a WHERE a.id = u.id AND k NOT IN (SELECT k FROM b WHERE b.id = u.id)), '') AS ids
FROM (SELECT DISTINCT id FROM o) AS u""")
def difference(spark, d):
    return _halves(spark, d).select(F.col("node_id").alias("id"), scalars.format_walk(scalars.difference("old", "new")).alias("ids"))


@query(f"""WITH {_HALVES}
SELECT coalesce(a.id, b.id) AS id, count(*) FILTER (b.k IS NULL) AS n_removed, count(*) FILTER (a.k = b.k) AS n_common, count(*) FILTER (a.k IS NULL) AS n_added,
       coalesce(string_agg(CAST(a.k AS VARCHAR), ',' ORDER BY a.k) FILTER (b.k IS NULL), '') AS removed,
       coalesce(string_agg(CAST(b.k AS VARCHAR), ',' ORDER BY b.k) FILTER (a.k IS NULL), '') AS added
FROM a FULL JOIN b ON a.id = b.id AND a.k = b.k GROUP BY 1""")
def partition_follows(spark, d):
    out = graph.parts_of(_halves(spark, d))
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("removed", "common", "added")]
    return out.select(F.col("node_id").alias("id"), *sizes, *[scalars.format_walk(c).alias(c) for c in ("removed", "added")])


@query(f"WITH {NODES} SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 50 AS BIGINT) AS batch FROM n")
def split_batches(spark, d):
    return setops.batches(views.nodes(spark, d).select("id"), ["id"], 50, "batch")


@query(f"""WITH {_HALVES} SELECT coalesce(a.id, b.id) AS id, coalesce(a.k, b.k) AS k,
CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' ELSE 'common' END AS part
FROM a FULL JOIN b ON a.id = b.id AND a.k = b.k""")
def partition_rows(spark, d):
    rows = views.events(spark, d).select(F.col("user_id").alias("id"), "k", "kind")
    return setops.partition_rows(rows.where("kind = 3").select("id", "k"), rows.where("kind <> 3").select("id", "k"), ["id", "k"])


# Events


@query(f"WITH {EVENTS_SQL} SELECT id, pubkey, kind, created_at FROM newest")
def latest_event_per_kind(spark, d):
    return events.latest(views.events(spark, d).select(*EVENTS.names)).select("id", "pubkey", "kind", "created_at")


@query(f"WITH {EVENTS_SQL} SELECT CASE kind WHEN 3 THEN 'follow_list' WHEN 0 THEN 'profile' ELSE 'unsupported' END AS handler, count(*) AS n FROM ev GROUP BY 1")
def event_dispatch(spark, d):
    return events.dispatched(views.events(spark, d)).groupBy("handler").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS_SQL}, {NODES} SELECT id, md5(CAST(user_id + 7 AS VARCHAR)) AS pubkey, kind FROM ev WHERE kind IN (0, 3) AND user_id + 7 IN (SELECT id FROM n)")
def known_author_filter(spark, d):
    """Events as if by the author whose id is 7 more, of whom some are unknown."""
    shifted = views.events(spark, d).withColumn("pubkey", F.md5((F.col("user_id") + 7).cast("string")))
    return events.known_authors(shifted, views.nodes(spark, d)).select("id", "pubkey", "kind")


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT pubkey, string_agg(key, ',' ORDER BY key) AS s FROM keys GROUP BY pubkey)
SELECT pubkey, coalesce(s, '') AS keys FROM newest LEFT JOIN l USING (pubkey) WHERE kind = 3""")
def parse_pubkeys(spark, d):
    lists = events.follow_keys(events.latest(views.events(spark, d).where("kind = 3").select(*EVENTS.names)))
    return lists.select("pubkey", F.array_join("keys", ",").alias("keys"))


def _newest(spark, d):
    """Newest events; each follow list also has the key of its author's id + 7: some are unknown."""
    more = F.array(F.array(F.lit("p"), F.md5((F.col("user_id") + 7).cast("string"))))
    return events.latest(views.events(spark, d).withColumn("tags", F.concat("tags", more)).select(*EVENTS.names))


def _applied(spark, d):
    """The graph of all users after their newest follow lists."""
    return events.apply_graph(_newest(spark, d), _store(spark, d), F.lit(NOW).cast("timestamp"), check=False)


_APPLIED = f"""{EVENTS_SQL}, {_GRAPH},
listed AS (SELECT pubkey, key FROM keys UNION SELECT pubkey, md5(CAST(user_id + 7 AS VARCHAR)) FROM newest WHERE kind = 3),
fresh AS (
  SELECT key AS pubkey, (SELECT max(id) FROM n) + row_number() OVER (ORDER BY key) AS id
  FROM (SELECT DISTINCT key FROM listed JOIN n USING (pubkey) WHERE status = 'active' AND key NOT IN (SELECT pubkey FROM n))),
everyone AS (SELECT id, pubkey, status FROM n UNION ALL SELECT id, pubkey, 'inactive' FROM fresh),
author AS (SELECT DISTINCT n.id AS node_id, pubkey FROM newest JOIN n USING (pubkey) WHERE kind = 3),
target AS (SELECT DISTINCT node_id, everyone.id AS k FROM author JOIN listed USING (pubkey) JOIN everyone ON everyone.pubkey = key),
after AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT node_id FROM author) UNION ALL SELECT node_id, k FROM target),
b AS (SELECT src AS node_id, dst AS k FROM e WHERE src IN (SELECT node_id FROM author)),
deltas AS (
  SELECT author.node_id, count(b.k) FILTER (target.k IS NULL) AS n_removed, count(b.k) FILTER (target.k = b.k) AS n_common,
         count(target.k) FILTER (b.k IS NULL) AS n_added
  FROM author LEFT JOIN (b FULL JOIN target ON b.node_id = target.node_id AND b.k = target.k) ON author.node_id = coalesce(b.node_id, target.node_id)
  GROUP BY author.node_id)"""


@query(f"WITH {_APPLIED} SELECT id, pubkey, status FROM everyone")
def resolve_ids(spark, d):
    return _applied(spark, d)[0].nodes.select("id", "pubkey", "status")


@query(f"WITH {_APPLIED} SELECT src, dst FROM after")
def update_follows(spark, d):
    return _applied(spark, d)[0].edges.select("src", "dst")


@query(f"WITH {_APPLIED} SELECT node_id, n_removed, n_common, n_added FROM deltas")
def follow_list_deltas(spark, d):
    deltas = _applied(spark, d)[1]
    return deltas.select("node_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("removed", "common", "added")])


@query(f"""WITH RECURSIVE {_APPLIED}, {_EVERY_WALK}, f2 AS (SELECT src, list(dst ORDER BY dst) AS fs FROM after GROUP BY src),
moved AS (SELECT node_id FROM deltas WHERE n_removed + n_added > 0),
hit AS (SELECT walk_id, min(i) AS cut FROM (SELECT walk_id, unnest(path) AS node, generate_subscripts(path, 1) AS i FROM walks) JOIN moved ON node = node_id GROUP BY walk_id),
{_grown("regrown", "SELECT walk_id, path[1:cut] AS path FROM walks JOIN hit USING (walk_id)", "f2", 4)}
SELECT walk_id, array_to_string(path, ',') AS path FROM walks WHERE walk_id NOT IN (SELECT walk_id FROM hit)
UNION ALL SELECT walk_id, array_to_string(path, ',') FROM regrown""")
def bulk_update_walks(spark, d):
    """All walks after all users' newest follow lists."""
    _, out, _ = events.apply_bulk(_newest(spark, d), _store(spark, d), walks.kept(_walks(spark, d)), CONFIG, F.lit(NOW).cast("timestamp"), check=False)
    return out.select("walk_id", scalars.format_walk("path").alias("path"))


@query(f"WITH {EVENTS_SQL} SELECT id, pubkey, created_at FROM newest WHERE kind = 3")
def stream_follow_lists(spark, d):
    """The newest follow list of each author, from the table as a stream."""
    return pipeline.newest_lists(views.event_stream(spark, d)).select("id", "pubkey", "created_at")


@query(f"""WITH {EVENTS_SQL}, early AS (SELECT pubkey, kind, max(created_at) AS t FROM ev WHERE CAST(id AS BIGINT) % 2 = 0 GROUP BY ALL),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, kind ORDER BY created_at DESC, id) AS r2 FROM ev WHERE CAST(id AS BIGINT) % 2 = 1) WHERE r2 = 1)
SELECT late.id, late.pubkey, late.kind, late.created_at FROM late LEFT JOIN early USING (pubkey, kind) WHERE t IS NULL OR late.created_at > t""")
def replace_events(spark, d):
    rows = views.events(spark, d).select(*EVENTS.names)
    odd = F.col("id").cast("long") % 2
    return events.replaced(rows.where(odd == 1), events.latest(rows.where(odd == 0))).select("id", "pubkey", "kind", "created_at")


@query()
def is_valid_pubkey(spark, d):
    return views.nodes(spark, d).select("id", F.sha2(F.col("id").cast("string"), 256).alias("pubkey")).withColumn("valid", scalars.is_valid_pubkey("pubkey"))


# Walks


@query(f"WITH RECURSIVE {WALKS} SELECT walk_id, array_to_string(path, ',') AS path FROM walks")
def walks_generate(spark, d):
    return _walks(spark, d).select("walk_id", scalars.format_walk("path").alias("path"))


@query(f"WITH RECURSIVE {WALKS} SELECT walk_id, array_to_string(path, ',') AS path FROM walks")
def walks_generate_by_join(spark, d):
    out = walks.generate(views.nodes(spark, d), _edges(spark, d), CONFIG, by_join=True)
    return out.select("walk_id", scalars.format_walk("path").alias("path"))


@query(f"WITH RECURSIVE {WALKS} SELECT walk_id, CAST(list_sum(path) AS BIGINT) AS total, array_to_string(path, ',') AS path FROM walks")
def walks_format(spark, d):
    text = _walks(spark, d).select("walk_id", scalars.format_walk("path").alias("path"))
    parsed = text.withColumn("p", scalars.parse_walk("path"))
    return parsed.select("walk_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), scalars.format_walk("p").alias("path"))


@query(f"WITH RECURSIVE {WALKS}, {ASKED} SELECT q.id AS node, count(walk_id) AS visits FROM q LEFT JOIN visits ON q.id = node GROUP BY q.id")
def visit_counts(spark, d):
    return walkstore.visit_counts(_walks(spark, d), _asked(spark, d))


@query(f"WITH RECURSIVE {WALKS} SELECT count(*) AS total_visits FROM visits")
def total_visits(spark, d):
    return walkstore.total_visits(_walks(spark, d))


@query(f"WITH RECURSIVE {WALKS} SELECT node, count(*) / (SELECT count(*) FROM visits) AS score FROM visits GROUP BY node")
def global_rank_handoff(spark, d):
    return rank.global_rank(walks.kept(_walks(spark, d)))


@query(f"WITH RECURSIVE {WALKS} SELECT node, count(*) / (SELECT count(*) FROM visits) AS score FROM visits GROUP BY node ORDER BY score DESC, node LIMIT 10")
def top_ranks(spark, d):
    return rank.top(rank.global_rank(walks.kept(_walks(spark, d))), 10)


@query("SELECT user_id AS node, count(*) / (SELECT count(*) FROM events) AS score FROM events GROUP BY user_id")
def visit_frequencies(spark, d):
    return rank.frequencies(views.events(spark, d).select(F.col("user_id").alias("node")))


@query(f"WITH RECURSIVE {WALKS} SELECT CAST(pos AS INT) AS pos, walk_id, array_to_string(path, ',') AS path FROM (VALUES (0, 41), (1, 0), (2, 23)) AS t(pos, walk_id) JOIN walks USING (walk_id)")
def walks_by_id(spark, d):
    out = walkstore.WalkStore(walks.kept(_walks(spark, d)), CONFIG).get(41, 0, 23)
    return out.select("pos", "walk_id", scalars.format_walk("path").alias("path"))


@query(f"""WITH RECURSIVE {WALKS} SELECT walk_id, array_to_string(path, ',') AS path FROM walks
UNION ALL SELECT (SELECT max(walk_id) FROM walks) + row_number() OVER (ORDER BY src, dst), src || ',' || dst FROM e""")
def walks_add(spark, d):
    """Every edge added as a walk."""
    store = walkstore.WalkStore(walks.kept(_walks(spark, d)), CONFIG)
    out = store.add_frame(_edges(spark, d).select(F.array("src", "dst").alias("path")))
    return out.walks.select("walk_id", scalars.format_walk("path").alias("path"))


@query(f"WITH RECURSIVE {WALKS} SELECT walk_id, array_to_string(path, ',') AS path FROM walks WHERE walk_id NOT IN (41, 0, 23)")
def walks_remove(spark, d):
    out = walkstore.WalkStore(walks.kept(_walks(spark, d)), CONFIG).remove(41, 0, 23)
    return out.walks.select("walk_id", scalars.format_walk("path").alias("path"))


@query(f"WITH RECURSIVE {_GRAPH}, {_EVERY_WALK} SELECT walk_id, array_to_string(path, ',') AS path FROM walks WHERE walk_id // {R} = 3")
def walks_generate_one(spark, d):
    return walks.generate_for(_store(spark, d), 3, CONFIG).select("walk_id", scalars.format_walk("path").alias("path"))


@query(f"WITH RECURSIVE {WALKS} SELECT walk_id, CAST(row_number() OVER (ORDER BY path, walk_id) - 1 AS BIGINT) AS place FROM walks")
def sorted_walks(spark, d):
    return setops.numbered(_walks(spark, d), ["path", "walk_id"], "place").select("walk_id", "place")


@query(f"WITH RECURSIVE {WALKS} SELECT walk_id FROM walks WHERE list_contains(path, 3) AND list_contains(path, 5)")
def walks_visiting_all(spark, d):
    return walkstore.visiting_all(_walks(spark, d), [3, 5])


@query(f"""WITH RECURSIVE {WALKS} SELECT DISTINCT walk_id FROM (
  SELECT walk_id, row_number() OVER (PARTITION BY node ORDER BY {rng.draw_sql(CONFIG.seed, "walk_id", "0", 9)[0]}, walk_id) AS r
  FROM visits WHERE node IN (1, 2, 3)) WHERE r <= 10""")
def walks_visiting_limited(spark, d):
    return walkstore.visiting(_walks(spark, d), 30, [1, 2, 3], CONFIG.seed)


@query(f"WITH RECURSIVE {WALKS} SELECT DISTINCT walk_id FROM visits WHERE node IN (1, 2, 3)")
def walks_visiting_every(spark, d):
    return walkstore.visiting(_walks(spark, d), -1, [1, 2, 3], CONFIG.seed)


@query(f"""WITH RECURSIVE {WALKS} SELECT walk_id, CAST(list_position(path, 3) AS BIGINT) AS cut FROM walks
WHERE list_contains(path, 3) AND path[list_position(path, 3) + 1] IN (SELECT dst FROM e WHERE src = 3 AND dst % 2 = 0)""")
def walks_containing_invalid_step(spark, d):
    gone = _edges(spark, d).where("src = 3 and dst % 2 = 0").agg(F.collect_list("dst").alias("gone"))
    marked = _walks(spark, d).join(F.broadcast(gone)).withColumn("cut", scalars.invalid_step("path", F.lit(3).cast("long"), F.col("gone")))
    return marked.where("cut is not null").select("walk_id", F.col("cut").cast("long").alias("cut"))


@query(f"WITH RECURSIVE {WALKS} SELECT walk_id, array_to_string(path, ',') AS path FROM walks WHERE path[1] <> 3")
def walks_remove_start(spark, d):
    return walks.remove_starting(_walks(spark, d), 3).select("walk_id", scalars.format_walk("path").alias("path"))


@query(f"WITH RECURSIVE {WALKS} SELECT walk_id, array_to_string(list_concat(path[1:(len(path) + 1) // 2], [-1, -2]), ',') AS path FROM walks")
def walks_prune_graft(spark, d):
    cut = F.expr("cast((size(path) + 1) div 2 as int)")
    new = F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"))
    return _walks(spark, d).select("walk_id", scalars.format_walk(scalars.prune_graft("path", cut, new)).alias("path"))


@query(f"""WITH RECURSIVE {WALKS} SELECT walk_id, array_to_string(path[list_position(path, 3) + 1:], ',') AS path FROM walks WHERE list_contains(path, 3)""")
def crop_walk(spark, d):
    out = _walks(spark, d).withColumn("rest", scalars.crop_walk("path", F.lit(3).cast("long")))
    return out.where("rest is not null").select("walk_id", scalars.format_walk("rest").alias("path"))


@query(f"""WITH RECURSIVE {WALKS}, pairs AS (
  SELECT a.walk_id, a.path AS old, b.path AS new FROM walks a JOIN walks b ON b.walk_id = a.walk_id + 1 WHERE a.walk_id % 2 = 0),
hits AS (SELECT walk_id, min(i) AS i FROM pairs, unnest(range(1, len(new) + 1)) AS u(i) WHERE list_contains(old, new[i]) GROUP BY walk_id)
SELECT walk_id, array_to_string(new[1:coalesce(i - 1, len(new))], ',') AS path FROM pairs LEFT JOIN hits USING (walk_id)""")
def trim_cycles(spark, d):
    all_walks = _walks(spark, d)
    two = all_walks.select((F.col("walk_id") - F.col("walk_id") % 2).alias("w"), (F.col("walk_id") % 2).alias("s"), "path")
    pairs = two.groupBy("w").agg(F.max(F.when(F.col("s") == 0, F.col("path"))).alias("old"), F.max(F.when(F.col("s") == 1, F.col("path"))).alias("new"))
    return pairs.select(F.col("w").alias("walk_id"), scalars.format_walk(scalars.trim_cycles("old", "new")).alias("path"))


@query(f"""WITH RECURSIVE {WALKS}, a AS (SELECT node, count(*) AS n FROM visits WHERE walk_id % 2 = 0 GROUP BY node),
b AS (SELECT node, count(*) AS n FROM visits WHERE walk_id % 2 = 1 GROUP BY node)
SELECT round(sum(abs(a.n / (SELECT sum(n) FROM a) - coalesce(b.n / (SELECT sum(n) FROM b), 0))), 9) AS distance FROM a LEFT JOIN b USING (node)""")
def rank_distance(spark, d):
    all_walks = _walks(spark, d)
    a, b = (rank.global_rank(all_walks.where(F.col("walk_id") % 2 == k)) for k in (0, 1))
    return rank.distance(a, b).select(F.round("distance", 9).alias("distance"))


@query(f"WITH RECURSIVE {WALKS} SELECT count(*) AS n_visits, 0 AS n_inconsistent FROM visits")
def index_consistency(spark, d):
    all_walks = walks.kept(_walks(spark, d))
    index = walkstore.visits(all_walks)
    wrong = walkstore.inconsistencies(all_walks, index).agg(F.count(F.lit(1)).alias("n_inconsistent"))
    return index.agg(F.count(F.lit(1)).alias("n_visits")).join(F.broadcast(wrong)).select("n_visits", F.col("n_inconsistent").cast("int").alias("n_inconsistent"))


_SHARE = "CAST(floor(CAST(CAST(k AS FLOAT) / CAST(n AS FLOAT) * CAST(visits AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT)) AS BIGINT)"


@query(f"""WITH RECURSIVE {WALKS}, c AS (SELECT node, count(*) AS visits FROM visits GROUP BY node),
o AS (SELECT src, count(*) AS n, count(*) FILTER (dst % 5 = 0) AS k FROM e GROUP BY src)
SELECT src AS node, visits, {_SHARE} AS n_walks FROM o JOIN c ON src = node""")
def expected_walks_to_update(spark, d):
    counts = walkstore.visit_counts(_walks(spark, d))
    out = _edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("dst") % 5 == 0).cast("long")).alias("k"))
    return out.join(counts, "node").select("node", "visits", scalars.walks_to_update(F.col("k"), F.col("n"), F.col("visits")).alias("n_walks"))


@query(f"""WITH RECURSIVE {WALKS}, c AS (SELECT node, count(*) AS visits FROM visits GROUP BY node)
SELECT id, coalesce(visits, 0) AS visits, CASE WHEN status = 'active' AND coalesce(visits, 0) < 100 THEN 'demote'
  WHEN status = 'inactive' AND coalesce(visits, 0) >= 60 THEN 'promote' END AS decision FROM n LEFT JOIN c ON id = node""")
def arbiter_decisions(spark, d):
    config = EngineConfig(demotion_multiplier=5.0, promotion_multiplier=3.0)
    counts = walkstore.visit_counts(_walks(spark, d))
    return arbiter.decisions(views.nodes(spark, d), counts, F.lit(NOW).cast("timestamp"), config, CONFIG.walks_per_node).select("id", "visits", "decision")


#: Walks of active nodes only, and what a scan makes of them.
_ACTIVE_WALKS = _grown("walks", f"SELECT id * {R} + r AS walk_id, [id] AS path FROM n, range({R}) AS t(r) WHERE status = 'active'", "f", walks.GENERATE)
_SCAN = f"""{_GRAPH}, {_ACTIVE_WALKS}, c AS (SELECT node, count(*) AS visits FROM (SELECT unnest(path) AS node FROM walks) GROUP BY node),
d AS (SELECT id, pubkey, status, CASE WHEN status = 'active' AND coalesce(visits, 0) < 60 THEN 'demote'
  WHEN status = 'inactive' AND coalesce(visits, 0) >= 20 THEN 'promote' END AS decision FROM n LEFT JOIN c ON id = node),
up AS (SELECT id, pubkey, (SELECT max(walk_id) FROM walks) + 1 + {R} * (row_number() OVER (ORDER BY id) - 1) AS first FROM d WHERE decision = 'promote')"""


def _scanned(spark, d):
    config = EngineConfig(demotion_multiplier=3.0, promotion_multiplier=1.0)
    store = _store(spark, d)
    started = walks.kept(walks.generate(store.nodes.where("status = 'active'"), store.edges, CONFIG))
    return arbiter.scan(store, started, F.lit(NOW).cast("timestamp"), config, CONFIG)


@query(f"WITH RECURSIVE {_SCAN} SELECT id, CASE decision WHEN 'demote' THEN 'inactive' WHEN 'promote' THEN 'active' ELSE status END AS status FROM d")
def arbiter_scan_nodes(spark, d):
    return _scanned(spark, d)[0].nodes.select("id", "status")


@query(f"""WITH RECURSIVE {_SCAN}, {_grown("more", f"SELECT first + r AS walk_id, [id] AS path FROM up, range({R}) AS t(r)", "f", walks.GENERATE)}
SELECT walk_id, array_to_string(path, ',') AS path FROM walks WHERE path[1] NOT IN (SELECT id FROM d WHERE decision = 'demote')
UNION ALL SELECT walk_id, array_to_string(path, ',') FROM more""")
def arbiter_scan_walks(spark, d):
    return _scanned(spark, d)[1].select("walk_id", scalars.format_walk("path").alias("path"))


@query(f"WITH RECURSIVE {_SCAN} SELECT pubkey FROM up")
def arbiter_scan_promoted(spark, d):
    return _scanned(spark, d)[2]


@query(f"WITH {EDGES} SELECT src, dst FROM e WHERE NOT (src = 3 AND dst IN (1, 2)) UNION SELECT 3, 5 UNION SELECT 3, 8")
def graph_update(spark, d):
    return _store(spark, d).update(graph.Delta(3, 3, removed=(1, 2), added=(5, 8))).edges


@query(f"WITH {NODES} SELECT id, CASE id WHEN 3 THEN 'inactive' WHEN 4 THEN 'active' ELSE status END AS status FROM n")
def graph_promote_demote(spark, d):
    return _store(spark, d).update(graph.Delta(DEMOTION, 3)).update(graph.Delta(PROMOTION, 4)).nodes.select("id", "status")


@query(f"WITH {EDGES} SELECT DISTINCT dst FROM e WHERE src = 3 AND dst NOT IN (1, 2, 5)")
def unchanged_follows(spark, d):
    return graph.unchanged(_edges(spark, d), graph.Delta(3, 3, removed=(1, 2), added=(5,)))


@query("""SELECT user_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view'
EXCEPT ALL SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_type <> 'view'""")
def difference_bags(spark, d):
    rows = views.events(spark, d).select(F.col("user_id").alias("id"), "k", "kind")
    return setops.difference_bags(rows.where("kind = 3").select("id", "k"), rows.where("kind <> 3").select("id", "k"))


@query("SELECT top_k, CAST(round(100 / (1 - 0.85) * pow(top_k, 0.85) * pow(10000000, 1 - 0.85)) AS BIGINT) AS length FROM (VALUES (5), (100), (200)) AS t(top_k)")
def required_length(spark, d):
    return spark.createDataFrame([(k, rank.required_length(k, 0.85)) for k in (5, 100, 200)], "top_k int, length long")


# Exact ranks of the trade graph, which has no cycle: a join for each level


_TRADE = """sold AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
d AS (SELECT c, count(*) AS n FROM sold GROUP BY c),
sup AS (SELECT s_suppkey AS s, s_nationkey AS k, START_S + 0.85 * coalesce(sum(START_C / n), 0) AS w FROM supplier LEFT JOIN (sold JOIN d USING (c)) ON s = s_suppkey GROUP BY ALL),
nat AS (SELECT n_nationkey AS k, n_regionkey AS r, START_S + 0.85 * coalesce(sum(w), 0) AS w FROM nation LEFT JOIN sup ON k = n_nationkey GROUP BY ALL),
reg AS (SELECT r_regionkey AS r, START_S + 0.85 * coalesce(sum(w), 0) AS w FROM region LEFT JOIN nat ON r = r_regionkey GROUP BY ALL),
every AS (
  SELECT c_custkey AS node, START_C AS w FROM customer
  UNION ALL SELECT s + 1000000000, w FROM sup UNION ALL SELECT k + 2000000000, w FROM nat UNION ALL SELECT r + 3000000000, w FROM reg)"""
_SCORES = "SELECT CAST(node AS BIGINT) AS node, round(w / (SELECT sum(w) FROM every), 9) AS score FROM every"


@query(f"WITH {_TRADE.replace('START_S', '1.0').replace('START_C', '1.0')} {_SCORES}")
def exact_rank_trade(spark, d):
    return _trade(spark, d, views.trade_nodes(spark, d).withColumn("w", F.lit(1.0)))


@query(f"""WITH {_TRADE.replace('START_S', '0.0').replace('START_C', 'CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END').replace("CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END AS w FROM customer", "CASE WHEN c_custkey = 1 THEN 1.0 ELSE 0.0 END AS w FROM customer")} {_SCORES}""")
def exact_personalized_trade(spark, d):
    start = (F.col("level") == 0) & (F.col("id") == 1)
    return _trade(spark, d, views.trade_nodes(spark, d).withColumn("w", F.when(start, 1.0).otherwise(0.0)))


def _trade(spark, d, starts):
    edges = views.trade_edges(spark, d)
    out = rank.exact_by_levels(starts, edges, CONFIG.alpha, levels=4)
    return out.select("node", F.round("score", 9).alias("score"))


@query()
def personalized_rank(spark, d):
    nodes, edges = views.nodes(spark, d), walks.kept(_edges(spark, d))
    store = GraphStore(nodes, edges)
    return rank.personalized(store, walks.kept(_walks(spark, d)), [1, 3], 5, CONFIG)


_REMOVED_STOP, _REMOVED_PICK = rng.draw_sql(CONFIG.seed, "walk_id", "0", 4 + walks.REMOVED)
_NEW_STOP, _NEW_PICK = rng.draw_sql(CONFIG.seed, "walk_id", "0", 4 + walks.NEW)
_N_ADDED = "CAST(floor(CAST(CAST(len(adds) AS FLOAT) / CAST(len(adds) + len(common) AS FLOAT) * CAST(visits AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT)) AS BIGINT)"


@query(f"""WITH RECURSIVE {WALKS}, mine AS (SELECT fs FROM f WHERE src = 3),
ch AS (
  SELECT fs[1:len(fs) // 2] AS removed, fs[len(fs) // 2 + 1:] AS common,
         [x for x in range(8) if NOT list_contains(fs, x) AND x <> 3] AS adds FROM mine),
e2 AS (SELECT src, dst FROM e WHERE NOT (src = 3 AND dst IN (SELECT unnest(removed) FROM ch)) UNION SELECT 3, unnest(adds) FROM ch),
f2 AS (SELECT src, list(dst ORDER BY dst) AS fs FROM e2 GROUP BY src),
hit AS (
  SELECT walk_id, path[1:list_position(path, 3)] AS head, CASE WHEN len(common) > 0 THEN common[{_REMOVED_PICK} % len(common) + 1] END AS too
  FROM walks, ch WHERE list_contains(path, 3) AND list_contains(removed, path[list_position(path, 3) + 1])),
{_grown("r1", "SELECT walk_id, list_append(head, too) AS path FROM hit WHERE too IS NOT NULL AND NOT list_contains(head, too)", "f2", 4 + walks.REMOVED)},
w1 AS (
  SELECT walk_id, path FROM walks WHERE walk_id NOT IN (SELECT walk_id FROM hit) UNION ALL SELECT walk_id, path FROM r1
  UNION ALL SELECT walk_id, head FROM hit WHERE too IS NULL OR list_contains(head, too)),
through AS (SELECT walk_id, path[1:list_position(path, 3)] AS head, row_number() OVER (ORDER BY {rng.draw_sql(CONFIG.seed, "walk_id", "0", 4 + walks.SAMPLE)[0]}, walk_id) AS place, count(*) OVER () AS visits FROM w1 WHERE list_contains(path, 3)),
chosen AS (
  SELECT walk_id, head, CASE WHEN {_NEW_STOP} <= {LIMIT} THEN adds[{_NEW_PICK} % len(adds) + 1] END AS too
  FROM through, ch WHERE len(adds) > 0 AND place <= {_N_ADDED}),
{_grown("r2", "SELECT walk_id, list_append(head, too) AS path FROM chosen WHERE too IS NOT NULL AND NOT list_contains(head, too)", "f2", 4 + walks.NEW)}
SELECT walk_id, array_to_string(path, ',') AS path FROM (
  SELECT walk_id, path FROM w1 WHERE walk_id NOT IN (SELECT walk_id FROM chosen) UNION ALL SELECT walk_id, path FROM r2
  UNION ALL SELECT walk_id, head FROM chosen WHERE too IS NULL OR list_contains(head, too))""")
def update_walks(spark, d):
    """All walks after node 3 has lost the first half of its follows and found others."""
    edges = walks.kept(_edges(spark, d))
    mine = sorted(r["dst"] for r in edges.where("src = 3").collect())
    removed, common = mine[: len(mine) // 2], mine[len(mine) // 2 :]
    added = [x for x in range(8) if x not in mine and x != 3]
    delta = spark.createDataFrame([(3, removed, added)], "node_id long, removed array<long>, added array<long>")
    after = walks.kept(graph.update_follows(edges, delta))
    out, _ = walks.update(walks.kept(_walks(spark, d)), after, 3, removed, common, added, CONFIG)
    return out.select("walk_id", scalars.format_walk("path").alias("path"))
