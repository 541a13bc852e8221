"""Building blocks of the SQL side: named subqueries put together on demand."""

from __future__ import annotations

from tracestrata.functions import vocabulary as V

METRICS = list(V.METRICS)
_SKELETON = ", ".join(f"('{a}')" for a in V.SKELETON)
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(V.ARCHETYPE_NAMES))

HUMAN = "NOT coalesce(actor_login LIKE '%[bot]', FALSE)"
POPULARITY = (
    "(activity = 'WatchEvent' AND action = 'started' OR activity = 'ForkEvent' "
    "OR activity = 'ReleaseEvent' AND action = 'published')"
)
ENGAGEMENT = (
    "(activity = 'IssuesEvent' AND action IN ('opened', 'reopened') "
    "OR activity = 'IssueCommentEvent' AND action = 'created')"
)
COLLABORATION = (
    "(activity = 'PullRequestEvent' AND action IN ('opened', 'reopened', 'synchronize') "
    "OR activity = 'PullRequestReviewEvent' AND action = 'submitted' "
    "OR activity = 'PullRequestReviewCommentEvent' AND action = 'created' "
    "OR activity = 'CommitCommentEvent' AND action = 'created')"
)
CREATION = "(activity = 'CreateEvent' AND create_ref_type = 'repository')"
CORE = (
    "(activity IN ('PushEvent', 'PullRequestReviewEvent') "
    "OR activity = 'CreateEvent' AND create_ref_type = 'branch' "
    "OR activity = 'DeleteEvent' AND delete_ref_type = 'branch' "
    "OR activity = 'IssuesEvent' AND action IN ('opened', 'reopened', 'closed') "
    "OR activity = 'PullRequestEvent' AND action IN ('opened', 'reopened', 'closed', 'synchronize') "
    "OR activity IN ('IssueCommentEvent', 'PullRequestReviewCommentEvent', 'CommitCommentEvent') "
    "AND action = 'created' "
    "OR activity = 'ReleaseEvent' AND action = 'published')"
)
STEP = (
    "CASE WHEN activity = 'PullRequestEvent' AND action = 'closed' AND pr_merged "
    "THEN 'PullRequestEvent_merged' "
    "WHEN activity = 'PullRequestEvent' AND action = 'closed' AND NOT pr_merged "
    "THEN 'PullRequestEvent_rejected' "
    "WHEN activity IN ('PullRequestEvent', 'IssuesEvent', 'IssueCommentEvent', "
    "'PullRequestReviewCommentEvent', 'CommitCommentEvent', 'ReleaseEvent') "
    "THEN activity || '_' || action "
    "WHEN activity = 'PullRequestReviewEvent' THEN activity || '_' || review_state "
    "WHEN activity = 'CreateEvent' THEN activity || '_' || create_ref_type "
    "WHEN activity = 'DeleteEvent' THEN activity || '_' || delete_ref_type "
    "ELSE activity END"
)
# Strata, members and models differ by these settings only.
QUARTILES = (0.25, 0.5, 0.75)
REFERENCE = (0.5, 0.9, 0.99)


def _cat(metric: str) -> str:
    q = f"q_{metric}"
    return (
        f"CASE WHEN {metric} = 0 THEN 'Zero' WHEN {metric} <= {q}[1] THEN 'Low' "
        f"WHEN {metric} <= {q}[2] THEN 'Medium' WHEN {metric} <= {q}[3] THEN 'High' "
        f"ELSE 'Giant' END AS {metric}_cat"
    )


def _member_rules() -> str:
    rules = []
    for name, table in V.ARCHETYPES.items():
        tests = " AND ".join(
            f"{d}_norm_cat IN ({', '.join(repr(c) for c in cats)})" for d, cats in table.items()
        )
        rules.append(f"SELECT repo_id, '{name}' AS archetype FROM strata WHERE {tests}")
    return " UNION ALL ".join(rules)


def blocks(
    quantiles=REFERENCE, group: str = "archetype", miner=(0.95, 0.8, 0.7, 100, 100)
) -> dict[str, str]:
    """Subqueries by name, in an order in which each uses only earlier ones.

    `group` is ``archetype`` (members of archetypes) or ``cohort`` (all events).
    """
    dependency, _, loop_two, min_activity, min_edge = miner
    qs = ", ".join(str(q) for q in quantiles)
    source = (
        "named JOIN members USING (repo_id)" if group == "archetype" else "named"
    )
    return {
        "ev": (
            "SELECT user_id * 4 + event_id % 4 AS repo_id, 'r' || user_id AS repo_name, "
            "k % 3 AS actor_id, "
            "CASE WHEN k % 20 = 0 THEN 'ci[bot]' ELSE 'u' || (k % 3) END AS actor_login, "
            "CASE event_type WHEN 'signup' THEN 'CreateEvent' WHEN 'click' THEN 'PushEvent' "
            "WHEN 'view' THEN 'WatchEvent' WHEN 'error' THEN 'IssuesEvent' "
            "WHEN 'purchase' THEN 'PullRequestEvent' END AS activity, ts AS timestamp, "
            "CASE WHEN event_type = 'view' THEN 'started' "
            "WHEN event_type = 'error' THEN ['opened', 'reopened', 'closed'][k % 3 + 1] "
            "WHEN event_type = 'purchase' "
            "THEN ['opened', 'reopened', 'closed', 'synchronize'][k % 4 + 1] END AS action, "
            "CASE WHEN event_type = 'click' THEN value END AS push_size, "
            "CASE WHEN event_type = 'signup' THEN "
            "CASE WHEN k % 2 = 0 THEN 'repository' ELSE 'branch' END END AS create_ref_type, "
            "CAST(NULL AS VARCHAR) AS delete_ref_type, CAST(NULL AS VARCHAR) AS review_state, "
            "CASE WHEN event_type = 'purchase' AND k % 4 = 2 THEN k % 8 = 2 END AS pr_merged, "
            "event_id AS event_seq, 'cohort' || (user_id % 5) AS cohort, value "
            "FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
        ),
        "lookup": (
            f"SELECT repo_id, min(timestamp) AS created FROM ev WHERE {CREATION} GROUP BY repo_id"
        ),
        "sums": (
            "SELECT repo_id, "
            "coalesce(sum(CASE WHEN activity = 'PushEvent' THEN push_size END), 0) AS workload_cum, "
            "count(DISTINCT CASE WHEN " + COLLABORATION + " THEN actor_id END) "
            "AS collaboration_intensity_cum, "
            f"count(*) FILTER (WHERE {ENGAGEMENT}) AS community_engagement_cum, "
            f"count(*) FILTER (WHERE {POPULARITY}) AS external_popularity_cum "
            f"FROM ev WHERE {HUMAN} GROUP BY repo_id"
        ),
        "aged": (
            "SELECT sums.*, created, CAST(trunc((epoch_us(TIMESTAMP '2024-02-01') "
            "- epoch_us(created)) // 86400000000) AS BIGINT) AS age_in_days "
            "FROM sums JOIN lookup USING (repo_id)"
        ),
        "metrics": (
            "SELECT repo_id, created, age_in_days, workload_cum, collaboration_intensity_cum, "
            "community_engagement_cum, external_popularity_cum, "
            + ", ".join(f"{d}_cum / age_in_days AS {d}_norm" for d in V.DIMENSIONS)
            + " FROM aged WHERE age_in_days > 0"
        ),
        "cuts": (
            "SELECT "
            + ", ".join(
                f"coalesce(quantile_cont({m}, [{qs}]) FILTER (WHERE {m} > 0), [0, 0, 0]) AS q_{m}"
                for m in METRICS
            )
            + " FROM metrics"
        ),
        "categories": (
            "SELECT metrics.*, " + ", ".join(_cat(m) for m in METRICS) + " FROM metrics, cuts"
        ),
        "strata": (
            "SELECT *, concat_ws('|', "
            + ", ".join(f"{m}_cat" for m in METRICS)
            + ") AS strato_id FROM categories"
        ),
        "members": _member_rules(),
        "named": f"SELECT *, {STEP} AS step FROM ev WHERE {HUMAN} AND {CORE}",
        "log": (
            f"SELECT {group} AS grp, actor_id || '_' || repo_id AS case_id, step AS activity, "
            f"timestamp, actor_login AS resource, event_seq FROM {source} WHERE step IS NOT NULL"
        ),
        "steps": (
            "SELECT *, lead(activity, 1) OVER w AS nxt, lead(activity, 2) OVER w AS nxt2, "
            "lead(timestamp, 1) OVER w AS nxt_time FROM log "
            "WINDOW w AS (PARTITION BY grp, case_id ORDER BY timestamp, event_seq)"
        ),
        "occ": "SELECT grp, activity, count(*) AS occurrences FROM log GROUP BY ALL",
        "dfg": (
            "SELECT grp, activity AS source, nxt AS target, count(*) AS frequency, "
            "avg((epoch_us(nxt_time) - epoch_us(timestamp)) / 1e6) AS mean_seconds "
            "FROM steps WHERE nxt IS NOT NULL GROUP BY ALL"
        ),
        "loops": (
            "SELECT grp, activity AS source, nxt AS target, count(*) AS two_loop FROM steps "
            "WHERE nxt2 = activity AND nxt <> activity GROUP BY ALL"
        ),
        "scored": (
            "SELECT d.*, coalesce(l.two_loop, 0) AS two_loop, "
            "CASE WHEN d.source = d.target THEN d.frequency / (d.frequency + 1.0) "
            "ELSE (d.frequency - coalesce(r.frequency, 0)) "
            "/ (d.frequency + coalesce(r.frequency, 0) + 1.0) END AS dependency, "
            "CASE WHEN d.source <> d.target THEN "
            "(coalesce(l.two_loop, 0) + coalesce(m.two_loop, 0)) "
            "/ (coalesce(l.two_loop, 0) + coalesce(m.two_loop, 0) + 1.0) END AS loop_two "
            "FROM dfg d "
            "LEFT JOIN dfg r ON r.grp = d.grp AND r.source = d.target AND r.target = d.source "
            "LEFT JOIN loops l ON l.grp = d.grp AND l.source = d.source AND l.target = d.target "
            "LEFT JOIN loops m ON m.grp = d.grp AND m.source = d.target AND m.target = d.source"
        ),
        "kept": (
            "SELECT s.* FROM scored s "
            "JOIN occ a ON a.grp = s.grp AND a.activity = s.source "
            "JOIN occ b ON b.grp = s.grp AND b.activity = s.target "
            f"WHERE s.frequency >= {min_edge} AND a.occurrences >= {min_activity} "
            f"AND b.occurrences >= {min_activity}"
        ),
        "selfs": (
            "SELECT grp, source AS activity FROM kept "
            f"WHERE source = target AND dependency >= {dependency}"
        ),
        "edges": (
            "SELECT * FROM (SELECT grp, source, target, frequency, mean_seconds, dependency, "
            f"CASE WHEN dependency >= {dependency} AND source = target THEN 'self_loop' "
            f"WHEN dependency >= {dependency} THEN 'dependency' "
            f"WHEN loop_two >= {loop_two} "
            "AND (grp, source) NOT IN (SELECT (grp, activity) FROM selfs) "
            "AND (grp, target) NOT IN (SELECT (grp, activity) FROM selfs) THEN 'two_loop' "
            "END AS kind FROM kept) WHERE kind IS NOT NULL"
        ),
        "inside": (
            "SELECT grp, source AS activity FROM edges UNION SELECT grp, target FROM edges"
        ),
        "nodes": (
            "SELECT o.*, i.activity IS NOT NULL AS in_net FROM occ o "
            "LEFT JOIN inside i ON i.grp = o.grp AND i.activity = o.activity"
        ),
        "models": "SELECT DISTINCT grp FROM occ",
        "size": (
            "SELECT grp, (SELECT count(*) FROM inside i WHERE i.grp = m.grp) AS num_nodes, "
            "(SELECT count(*) FROM edges e WHERE e.grp = m.grp) AS num_edges FROM models m"
        ),
        "complexity": (
            "SELECT *, CASE WHEN num_nodes > 1 THEN num_edges / (num_nodes * (num_nodes - 1)) "
            "ELSE 0.0 END AS density, "
            "CASE WHEN num_nodes > 1 THEN num_edges / num_nodes ELSE 0.0 END AS avg_degree, "
            "CASE WHEN num_nodes > 1 THEN CAST(num_edges - num_nodes + 1 AS DOUBLE) ELSE 0.0 END "
            "AS cyclomatic_complexity FROM size"
        ),
        "top": (
            "SELECT m.grp, coalesce(t.activity, 'None') AS top_activity, "
            "coalesce(t.occurrences, -1) AS top_count FROM models m LEFT JOIN "
            "(SELECT *, row_number() OVER (PARTITION BY grp ORDER BY occurrences DESC, activity) "
            "AS r FROM nodes WHERE in_net) t ON t.grp = m.grp AND t.r = 1"
        ),
        "slow": (
            "SELECT m.grp, coalesce(t.source, 'None') AS slow_source, "
            "coalesce(t.target, 'None') AS slow_target, coalesce(t.sec, -1.0) AS slow_seconds "
            "FROM models m LEFT JOIN (SELECT *, coalesce(mean_seconds, 0) AS sec, "
            "row_number() OVER (PARTITION BY grp "
            "ORDER BY coalesce(mean_seconds, 0) DESC, source, target) AS r FROM edges) t "
            "ON t.grp = m.grp AND t.r = 1"
        ),
        "profile": (
            "SELECT grp, num_nodes, num_edges, density, cyclomatic_complexity, avg_degree, "
            "top_activity || ' (' || top_count || ')' AS most_freq_activity, "
            "slow_source || '->' || slow_target || ' (' "
            "|| CAST(round(slow_seconds / 3600.0, 2) AS VARCHAR) || 'h)' AS slowest_edge "
            "FROM complexity JOIN top USING (grp) JOIN slow USING (grp)"
        ),
        "skeleton": f"SELECT * FROM (VALUES {_SKELETON}) t(activity)",
        "grid": (
            "SELECT m.grp, s.activity AS source, t.activity AS target "
            "FROM models m, skeleton s, skeleton t"
        ),
        "freq": (
            "SELECT g.*, CAST(coalesce(e.frequency, 0) AS DOUBLE) AS value FROM grid g "
            "LEFT JOIN edges e USING (grp, source, target)"
        ),
        "perf": (
            "SELECT g.*, coalesce(e.mean_seconds, -1.0) AS value FROM grid g "
            "LEFT JOIN edges e USING (grp, source, target)"
        ),
        "freq_total": "SELECT grp, sum(value) AS total FROM freq GROUP BY grp",
        "perf_total": "SELECT grp, sum(value) AS total FROM perf GROUP BY grp",
        "freq_norm": (
            "SELECT grp, source, target, CASE WHEN total > 0 THEN value / total ELSE value END "
            "AS value FROM freq JOIN freq_total USING (grp)"
        ),
        "perf_norm": (
            "SELECT grp, source, target, CASE WHEN total > 0 THEN value / total ELSE value END "
            "AS value FROM perf JOIN perf_total USING (grp)"
        ),
        "perf_time": (
            "SELECT grp, source, target, "
            "CASE WHEN value <> -1 THEN value / sum(CASE WHEN value <> -1 THEN value END) "
            "OVER (PARTITION BY grp) ELSE 0 END AS value, value <> -1 AS present FROM perf"
        ),
        "names": (
            f"SELECT * FROM (VALUES {_NAMES}) t(pos, grp)"
            if group == "archetype"
            else "SELECT grp, row_number() OVER (ORDER BY grp) AS pos FROM models"
        ),
        "all_pairs": (
            "SELECT a.grp AS group_a, b.grp AS group_b FROM names a, names b"
        ),
        "half_pairs": (
            "SELECT a.grp AS group_a, b.grp AS group_b FROM names a, names b WHERE a.pos < b.pos"
        ),
        "jac_nodes": _jaccard("occ", "activity"),
        "jac_edges": _jaccard("edges", "source || '>' || target"),
        "frob_freq": _frobenius("freq_norm"),
        "frob_perf": _frobenius("perf_norm"),
        "deltas": (
            "SELECT p.group_a, p.group_b, 'Frequency' AS metric, a.source, a.target, "
            "a.value - b.value AS delta FROM half_pairs p "
            "JOIN freq_norm a ON a.grp = p.group_a JOIN freq_norm b ON b.grp = p.group_b "
            "AND b.source = a.source AND b.target = a.target "
            "WHERE a.value <> 0 OR b.value <> 0 UNION ALL "
            "SELECT p.group_a, p.group_b, 'Performance', a.source, a.target, a.value - b.value "
            "FROM half_pairs p JOIN perf_time a ON a.grp = p.group_a "
            "JOIN perf_time b ON b.grp = p.group_b "
            "AND b.source = a.source AND b.target = a.target WHERE a.present OR b.present"
        ),
        "hours": (
            "SELECT DISTINCT date_trunc('hour', timestamp) AS moment FROM ev "
            f"WHERE NOT ({HUMAN})"
        ),
        "days": (
            "SELECT CAST(moment AS DATE) AS day, count(*) AS hours FROM hours GROUP BY 1"
        ),
        "order_days": (
            "SELECT CAST(o_orderdate AS DATE) AS day, "
            "count(DISTINCT date_trunc('hour', o_orderdate)) AS hours FROM orders GROUP BY 1"
        ),
        "periods": (
            "SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM "
            "(SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS run FROM order_days) "
            "GROUP BY run"
        ),
    }


def sequence_dfg(table: str, case: str, activity: str, order: str) -> str:
    """Directly-follows counts, length-two loops and terminal activities of a table."""
    return (
        f"SELECT source, target, count(*) AS frequency, "
        f"count(*) FILTER (WHERE after = source AND target <> source) AS two_loop FROM "
        f"(SELECT {activity} AS source, lead({activity}, 1) OVER w AS target, "
        f"lead({activity}, 2) OVER w AS after FROM {table} "
        f"WINDOW w AS (PARTITION BY {case} ORDER BY {order})) GROUP BY 1, 2"
    )


def _jaccard(source: str, item: str) -> str:
    def items(side: str) -> str:
        return f"(SELECT {item} FROM {source} s WHERE s.grp = p.{side})"

    both = f"(SELECT count(*) FROM ({items('group_a')} INTERSECT {items('group_b')}))"
    either = f"(SELECT count(*) FROM ({items('group_a')} UNION {items('group_b')}))"
    return (
        f"SELECT group_a, group_b, CASE WHEN {either} = 0 THEN 1.0 "
        f"ELSE {both} / {either} END AS similarity FROM all_pairs p"
    )


def _frobenius(matrix: str) -> str:
    return (
        "SELECT p.group_a, p.group_b, coalesce(d.distance, 0.0) AS distance FROM all_pairs p "
        "LEFT JOIN (SELECT a.grp AS group_a, b.grp AS group_b, "
        "sqrt(sum((a.value - b.value) * (a.value - b.value))) AS distance "
        f"FROM {matrix} a JOIN {matrix} b ON a.source = b.source AND a.target = b.target "
        "GROUP BY 1, 2) d ON d.group_a = p.group_a AND d.group_b = p.group_b"
    )


def query(final: str, **settings) -> str:
    """`final` preceded by all building blocks; unused ones cost nothing."""
    listed = ", ".join(f"{name} AS ({body})" for name, body in blocks(**settings).items())
    return f"WITH {listed} {final}"
