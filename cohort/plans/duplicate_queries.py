"""Duplicate, cluster, split and migration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohort.functions.bits import hamming, median_print
from cohort.operators import components, cosine, migration, pairs, splits
from cohort.plans.inputs import (ASSIGNED_SQL, BITS, CLUSTERS_SQL, DIMENSIONS, DISTANCE,
                                 DOCS_SQL, GROUPS_SQL, PRINTS_SQL, documents, fingerprints,
                                 rounded, table)
from cohort.operators.skew import join_groups
from cohort.plans.registry import query
from cohort.session import scratch_path, written
from cohort.sources import images


def label_pairs(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Print groups within each label and their pair table, both written."""
    groups = written(pairs.print_groups(prints, "id", ["label"]), "groups")
    found = written(pairs.within_label_pairs(groups, DISTANCE, BITS), "pairs")
    return groups, found


def clustered(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows with ``first`` and ``cluster_id``, written."""
    prints = fingerprints(spark, folder)
    groups = written(pairs.print_groups(prints, "id", ["label"]), "groups")
    links = written(pairs.spanning_links(groups, DISTANCE, BITS), "links")
    return written(components.clusters_from_prints(prints, groups, links, "id"), "clustered")


def assigned(spark: SparkSession, folder: str) -> DataFrame:
    return written(splits.split_rows(clustered(spark, folder), "id"), "assigned")


@query("w11_fingerprints", f"WITH {PRINTS_SQL} SELECT id, label, print FROM prints")
def print_of_every_text(spark, folder):
    return fingerprints(spark, folder).select("id", "label", "print")


@query("w11_vector_prints", """WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, list_sort(embedding)[32]::DOUBLE
    + list_sort(embedding)[33]::DOUBLE AS m FROM embeddings)
SELECT vec_id, lpad(lower(to_hex(list_sum(list_transform(v, lambda x, i: CASE WHEN 2 * x > m
  THEN 1::UBIGINT << (64 - i)::INT ELSE 0::UBIGINT END))::UBIGINT)), 16, '0') AS print
FROM v""")
def print_of_every_vector(spark, folder):
    vector = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        "vec_id", median_print(vector, DIMENSIONS).alias("print"))


@query("j1_exact_groups", f"""WITH {PRINTS_SQL}
SELECT print, count(*) AS group_size, min(id) AS path1, list_sort(list(id))[2] AS path2
FROM prints WHERE print IS NOT NULL GROUP BY print HAVING count(*) > 1""")
def exact_groups(spark, folder):
    return pairs.exact_groups(fingerprints(spark, folder), "id")


@query("a13_hash_totals", f"""WITH {PRINTS_SQL},
g AS (SELECT print, count(*) AS n FROM prints WHERE print IS NOT NULL GROUP BY print)
SELECT (SELECT count(*) FROM prints) AS images, (SELECT sum(n)::BIGINT FROM g) AS hashed,
  (SELECT count(*) FROM g WHERE n > 1) AS exact_groups,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM g WHERE n > 1) AS rows_in_groups""")
def hash_totals(spark, folder):
    return pairs.hash_totals(fingerprints(spark, folder))


CROSS_SQL = PRINTS_SQL + """,
sided AS (
  SELECT print, w, count(*) FILTER (original_split = 'train') AS n_train,
    count(*) FILTER (original_split = 'test') AS n_test,
    min(id) FILTER (original_split = 'train') AS first_train,
    min(id) FILTER (original_split = 'test') AS first_test
  FROM prints WHERE print IS NOT NULL GROUP BY print, w),
crossing AS (
  SELECT a.print AS train_print, b.print AS test_print, a.first_train, b.first_test, a.n_train,
    b.n_test, bit_count(xor(a.w, b.w))::INT AS distance, (a.n_train * b.n_test)::BIGINT AS pairs
  FROM sided a JOIN sided b ON a.n_train > 0 AND b.n_test > 0
    AND bit_count(xor(a.w, b.w)) <= 3)"""


def _crossing(prints):
    groups = written(pairs.side_groups(prints, "id"), "sides")
    return pairs.cross_split_pairs(groups, DISTANCE, BITS)


@query("j2_cross_split_pairs", f"WITH {CROSS_SQL} SELECT * FROM crossing")
def cross_split_pairs(spark, folder):
    return _crossing(fingerprints(spark, folder))


@query("j3_within_label_pairs", f"""WITH {GROUPS_SQL}
SELECT label, print1, print2, first1, first2, n1, n2, distance, pairs FROM near""")
def within_label_pairs(spark, folder):
    return label_pairs(fingerprints(spark, folder))[1]


@query("j3_pairs_across_labels", PRINTS_SQL.join(["WITH ", """,
g AS (SELECT print, w, count(*) AS n, min(id) AS first FROM prints WHERE print IS NOT NULL
  GROUP BY print, w)
SELECT a.print AS print1, b.print AS print2, a.first AS first1, b.first AS first2, a.n AS n1,
  b.n AS n2, bit_count(xor(a.w, b.w))::INT AS distance, (a.n * b.n)::BIGINT AS pairs
FROM g a JOIN g b ON a.print < b.print AND bit_count(xor(a.w, b.w)) <= 3
UNION ALL SELECT print, print, first, first, n, n, 0, (n * (n - 1) // 2)::BIGINT
FROM g WHERE n > 1"""]))
def pairs_across_labels(spark, folder):
    groups = written(pairs.print_groups(fingerprints(spark, folder), "id"), "groups")
    return pairs.within_label_pairs(groups, DISTANCE, BITS, within=())


@query("a8_dedup_report", f"""WITH {CROSS_SQL},
rows_of AS (SELECT id, print, original_split FROM prints),
all_pairs AS (
  SELECT c.distance, t.id AS train_path, s.id AS test_path, row_number() OVER (
      PARTITION BY c.distance ORDER BY s.id, t.id)::INT AS example
  FROM crossing c JOIN rows_of t ON t.print = c.train_print AND t.original_split = 'train'
  JOIN rows_of s ON s.print = c.test_print AND s.original_split = 'test'),
totals AS (SELECT distance, count(*) AS pairs FROM all_pairs GROUP BY distance)
SELECT distance, CASE WHEN distance = 0 THEN 'EXACT DUPLICATE' WHEN distance <= 3
    THEN 'HIGH RISK' ELSE 'MODERATE RISK' END AS tier, pairs,
  greatest(pairs - 10, 0) AS not_shown, example, train_path, test_path
FROM all_pairs JOIN totals USING (distance) WHERE example <= 10""")
def dedup_report(spark, folder):
    prints = fingerprints(spark, folder)
    return pairs.distance_report(written(_crossing(prints), "crossing"), prints, "id")


@query("j4_cosine_pairs", """WITH v AS (
  SELECT min(vec_id) AS first, count(*) AS n, embedding::DOUBLE[] AS v FROM embeddings
  GROUP BY embedding)
SELECT a.first AS first1, b.first AS first2,
  round(list_cosine_similarity(a.v, b.v), 6) AS cosine, (a.n * b.n)::BIGINT AS pairs
FROM v a JOIN v b ON a.first < b.first AND list_cosine_similarity(a.v, b.v) >= 0.35
UNION ALL SELECT first, first, 1.0, (n * (n - 1) // 2)::BIGINT FROM v WHERE n > 1""")
def cosine_pairs(spark, folder):
    groups = cosine.vector_groups(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return rounded(cosine.cosine_pairs(groups, 0.35), "cosine")


@query("j5_pool_clusters", "WITH RECURSIVE " + GROUPS_SQL + """,
pool AS (SELECT doc_id AS id FROM labels),
link AS (
  SELECT first1 AS a, first2 AS b FROM near WHERE distance > 0
  UNION ALL SELECT g.first, p.id FROM prints p JOIN groups g USING (label, print)
  WHERE g.first < p.id),
edge AS (
  SELECT a AS u, b AS v FROM link WHERE a IN (FROM pool) AND b IN (FROM pool)
  UNION SELECT b, a FROM link WHERE a IN (FROM pool) AND b IN (FROM pool)),
reach AS (SELECT id AS u, id AS v FROM pool
  UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u)
SELECT u AS id, min(v) AS cluster_id FROM reach GROUP BY u""")
def pool_clusters(spark, folder):
    prints = fingerprints(spark, folder)
    groups, found = label_pairs(prints)
    rows = components.clusters_from_prints(prints, groups, found, "id")
    links = written(pairs.pair_links(found, rows, "id"), "links")
    pool = table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return components.build_clusters(pool, links, "id")


@query("g1_link_components", f"""WITH {CLUSTERS_SQL}
SELECT label, print, n AS copies, cluster_id AS component,
  count(*) OVER (PARTITION BY cluster_id) AS prints FROM groups JOIN root USING (first)""")
def link_components(spark, folder):
    """Components of print groups by spanning links; the SQL follows all near pairs."""
    groups = written(pairs.print_groups(fingerprints(spark, folder), "id", ["label"]), "groups")
    links = written(pairs.spanning_links(groups, DISTANCE, BITS), "links")
    found = components.connected_components(links, "first1", "first2").withColumnRenamed(
        "node", "first")
    named = groups.join(found, "first", "left").select(
        "label", "print", F.col("n").alias("copies"),
        F.coalesce("component", "first").alias("component"))
    sizes = written(named.groupBy("component").agg(F.count("*").alias("prints")), "sizes")
    return join_groups(named, sizes, ["component"], "prints")


@query("g2_clusters", f"WITH {CLUSTERS_SQL} SELECT id, label, cluster_id FROM clustered")
def clusters(spark, folder):
    return clustered(spark, folder).select("id", "label", "cluster_id")


SIZES_SQL = CLUSTERS_SQL + """,
sizes AS (SELECT cluster_id, count(*) AS size FROM clustered GROUP BY cluster_id)"""


@query("g3_cluster_stats", f"""WITH {SIZES_SQL}
SELECT count(*) AS clusters, count(*) FILTER (size = 1) AS singletons,
  count(*) FILTER (size > 1) AS multi, max(size) AS largest FROM sizes""")
def cluster_stats(spark, folder):
    return components.cluster_stats(clustered(spark, folder))


@query("g4_majority_label", f"""WITH {CLUSTERS_SQL},
vote AS (SELECT cluster_id, label, count(*) AS votes, min(id) AS seen FROM clustered
  GROUP BY cluster_id, label)
SELECT cluster_id, arg_min(label, (-votes, seen)) AS cluster_label, sum(votes)::BIGINT AS size,
  count(*) > 1 AS mixed FROM vote GROUP BY cluster_id""")
def majority_label(spark, folder):
    return components.cluster_labels(clustered(spark, folder), "id")


BOUNDARY_SQL = CLUSTERS_SQL + """,
boundary AS (
  SELECT cluster_id, count(*) AS size, count(*) FILTER (original_split = 'train') AS n_train,
    count(*) FILTER (original_split = 'test') AS n_test
  FROM clustered GROUP BY cluster_id HAVING n_train > 0 AND n_test > 0)"""


@query("g5_cross_boundary", f"WITH {BOUNDARY_SQL} SELECT * FROM boundary")
def cross_boundary(spark, folder):
    return components.cross_boundary(clustered(spark, folder))


@query("g6_sizes", f"""WITH {BOUNDARY_SQL}
SELECT size, count(*) AS clusters FROM boundary GROUP BY size""")
def boundary_sizes(spark, folder):
    return components.size_histogram(components.cross_boundary(clustered(spark, folder)))


@query("g7_largest", f"""WITH {BOUNDARY_SQL},
top AS (SELECT cluster_id, size, row_number() OVER (ORDER BY size DESC, cluster_id)::INT
    AS cluster_rank FROM boundary ORDER BY size DESC, cluster_id LIMIT 5)
SELECT cluster_rank, cluster_id, size, id, label, original
FROM clustered JOIN top USING (cluster_id)""")
def largest(spark, folder):
    rows = clustered(spark, folder)
    found = components.largest_clusters(rows, components.cross_boundary(rows), 5, "id")
    return found.select("cluster_rank", "cluster_id", "size", "id", "label", "original")


@query("sp1_assignment", f"WITH {ASSIGNED_SQL} SELECT id, label, cluster_id, split FROM assigned")
def assignment(spark, folder):
    return assigned(spark, folder).select("id", "label", "cluster_id", "split")


@query("sp3_split_counts", f"""WITH {ASSIGNED_SQL}
SELECT label, split, count(*) AS n,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY label), 6) AS pct,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY label)
    - CASE split WHEN 'train' THEN 70 ELSE 15 END, 6) AS deviation
FROM assigned GROUP BY label, split""")
def split_counts(spark, folder):
    return rounded(splits.split_counts(assigned(spark, folder)), "pct", "deviation")


@query("sp3_pool_summary", f"""WITH {ASSIGNED_SQL},
shares AS (
  SELECT split, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct
  FROM assigned GROUP BY split),
deviations AS (SELECT *, pct - CASE split WHEN 'train' THEN 70 ELSE 15 END AS d FROM shares)
SELECT split, n, round(pct, 6) AS pct, round(d, 6) AS deviation,
  round(max(abs(d)) OVER (), 6) AS max_deviation FROM deviations""")
def pool_summary(spark, folder):
    return rounded(splits.pool_summary(assigned(spark, folder)), "pct", "deviation",
                   "max_deviation")


@query("sp4_leakage", f"""WITH {ASSIGNED_SQL},
spread AS (SELECT cluster_id FROM assigned GROUP BY cluster_id
  HAVING count(*) > 1 AND count(DISTINCT split) > 1)
SELECT count(*) AS leaking, (SELECT count(*) FROM assigned WHERE split IS NULL) AS unassigned
FROM spread""")
def leakage(spark, folder):
    rows = assigned(spark, folder)
    lost = splits.unassigned(documents(spark, folder).select("id"), rows, "id")
    return (splits.leaking_clusters(rows).select(F.lit("leaking").alias("kind"))
            .unionByName(lost.select(F.lit("unassigned").alias("kind")))
            .agg(F.count_if(F.col("kind") == "leaking").alias("leaking"),
                 F.count_if(F.col("kind") == "unassigned").alias("unassigned")))


@query("sp4_strict_leakage", f"""WITH {ASSIGNED_SQL},
anyg AS (SELECT print, w, count(*) AS n FROM prints WHERE print IS NOT NULL GROUP BY print, w),
anypair AS (
  SELECT a.print AS print1, b.print AS print2, bit_count(xor(a.w, b.w))::INT AS distance,
    (a.n * b.n)::BIGINT AS pairs
  FROM anyg a JOIN anyg b ON a.print < b.print AND bit_count(xor(a.w, b.w)) <= 3
  UNION ALL SELECT print, print, 0, (n * (n - 1) // 2)::BIGINT FROM anyg WHERE n > 1),
place AS (SELECT DISTINCT print, split FROM assigned),
ends AS (
  SELECT print1, print2, split FROM anypair JOIN place ON print = print1
  UNION SELECT print1, print2, split FROM anypair JOIN place ON print = print2),
spread AS (SELECT print1, print2, string_agg(split, '+' ORDER BY split) AS pools
  FROM ends GROUP BY print1, print2 HAVING count(*) > 1)
SELECT print1, print2, distance, pairs, pools FROM anypair JOIN spread USING (print1, print2)""")
def strict_leakage(spark, folder):
    rows = assigned(spark, folder)
    groups = written(pairs.print_groups(rows, "id"), "groups")
    found = pairs.within_label_pairs(groups, DISTANCE, BITS, within=())
    return splits.leaking_pairs(rows, found)


@query("sp5_unclustered_split", ASSIGNED_SQL.join(["WITH ", """
SELECT cluster_label AS label, split, count(*) AS n FROM assigned
JOIN cluster USING (cluster_id) GROUP BY 1, 2"""]).replace(
    "coalesce(root.cluster_id, p.id) AS cluster_id", "p.id AS cluster_id"))
def unclustered_split(spark, folder):
    rows = splits.unclustered(documents(spark, folder).select("id", "label"), "id")
    return splits.split_rows(rows, "id").groupBy("label", "split").agg(F.count("*").alias("n"))


MIGRATED_SQL = ASSIGNED_SQL + """,
migrated AS (SELECT id, 'doc_' || (id % 97) AS filename, label, original, split AS new
  FROM assigned),
crossed AS (SELECT *, (original = 'Training' AND new <> 'train')
  OR (original = 'Testing' AND new = 'train') AS moved FROM migrated)"""


def _migrations(spark, folder):
    """Files meet by id; their names repeat, as they do in real folders."""
    rows = assigned(spark, folder)
    name = F.concat(F.lit("doc_"), F.col("id") % 97).alias("filename")
    original = documents(spark, folder).select("id", name, "label", "original")
    return migration.migration_table(original, rows.select("id", "split"), "id")


@query("j6_migration_table", f"WITH {MIGRATED_SQL} SELECT * FROM migrated")
def migration_table(spark, folder):
    return _migrations(spark, folder)


@query("j6_ambiguous_names", f"""WITH {DOCS_SQL}
SELECT source || '_' || n_chars AS filename, count(*) AS files FROM docs
GROUP BY 1 HAVING count(*) > 1""")
def ambiguous_names(spark, folder):
    name = F.concat_ws("_", "source", "n_chars").alias("filename")
    return migration.ambiguous_names(documents(spark, folder).select(name))


@query("j7_cluster_moves", f"""WITH {MIGRATED_SQL},
spanning AS (SELECT cluster_id, count(*) AS size FROM assigned GROUP BY cluster_id
  HAVING count(DISTINCT original) > 1)
SELECT a.id, a.cluster_id, s.size, a.original,
  CASE WHEN a.id % 10 = 0 THEN '?' ELSE a.split END AS new
FROM assigned a JOIN spanning s USING (cluster_id)""")
def cluster_moves(spark, folder):
    rows = assigned(spark, folder)
    new = rows.where("id % 10 <> 0").select("id", "split")
    found = migration.cluster_moves(rows.drop("split"), components.cross_boundary(rows), new,
                                    "id")
    return found.select("id", "cluster_id", "size", "original", "new")


@query("a9_migration_matrix", f"""WITH {MIGRATED_SQL},
counts AS (SELECT original, count(*) FILTER (new = 'train') AS train,
  count(*) FILTER (new = 'val') AS val, count(*) FILTER (new = 'test') AS test,
  count(*) AS total FROM migrated GROUP BY original)
SELECT *, round(train * 100.0::DOUBLE / total, 6) AS train_pct,
  round(val * 100.0::DOUBLE / total, 6) AS val_pct,
  round(test * 100.0::DOUBLE / total, 6) AS test_pct FROM counts""")
def migration_matrix(spark, folder):
    return rounded(migration.migration_matrix(_migrations(spark, folder)), "train_pct",
                   "val_pct", "test_pct")


@query("a10_leak_directions", f"""WITH {MIGRATED_SQL}
SELECT original, count(*) AS total, count(*) FILTER (NOT moved) AS kept,
  count(*) FILTER (moved) AS crossed,
  round(count(*) FILTER (moved) * 100.0::DOUBLE / count(*), 6) AS crossed_pct
FROM crossed GROUP BY original""")
def leak_directions(spark, folder):
    return rounded(migration.leak_directions(_migrations(spark, folder)), "crossed_pct")


@query("a11_class_migration", f"""WITH {MIGRATED_SQL}
SELECT label, count(*) AS total,
  count(*) FILTER (original = 'Training' AND new <> 'train') AS train_out,
  count(*) FILTER (original = 'Testing' AND new = 'train') AS test_in,
  count(*) FILTER (moved) AS moved,
  round(count(*) FILTER (moved) * 100.0::DOUBLE / count(*), 6) AS moved_pct
FROM crossed GROUP BY label""")
def class_migration(spark, folder):
    return rounded(migration.class_migration(_migrations(spark, folder)), "moved_pct")


@query("a12_overall_migration", f"""WITH {MIGRATED_SQL},
t AS (SELECT count(*) AS n, count(*) FILTER (moved) AS moved,
  count(*) FILTER (original = 'Training')::DOUBLE AS a,
  count(*) FILTER (new = 'train')::DOUBLE AS b FROM crossed)
SELECT n AS total, moved, round(moved * 100.0::DOUBLE / n, 6) AS moved_pct,
  round((a * (n - b) + (n - a) * b) * 100 / n / n, 6) AS chance_pct,
  CASE WHEN moved = 0 THEN 'boundary preserved' ELSE 'boundary crossed' END AS verdict FROM t""")
def overall_migration(spark, folder):
    return rounded(migration.overall_migration(_migrations(spark, folder)), "moved_pct",
                   "chance_pct")


@query("p7_hamming", """WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, list_sort(embedding)[32]::DOUBLE
    + list_sort(embedding)[33]::DOUBLE AS m FROM embeddings),
w AS (SELECT vec_id, list_sum(list_transform(v, lambda x, i: CASE WHEN 2 * x > m
  THEN 1::UBIGINT << (64 - i)::INT ELSE 0::UBIGINT END))::UBIGINT AS w FROM v)
SELECT a.vec_id, coalesce(bit_count(xor(a.w, b.w))::DOUBLE, 'inf'::DOUBLE) < 1000 AS known,
  bit_count(xor(a.w, b.w))::INT AS distance
FROM w a LEFT JOIN w b ON b.vec_id = a.vec_id + 1""")
def hamming_distances(spark, folder):
    prints = print_of_every_vector(spark, folder)
    following = prints.select((F.col("vec_id") - 1).alias("vec_id"), F.col("print").alias("next"))
    far = prints.join(following, "vec_id", "left").select(
        "vec_id", hamming(F.col("print"), F.col("next"), BITS).alias("d"))
    return far.select("vec_id", (F.col("d") < 1000).alias("known"),
                      F.when(F.col("d") < 1000, F.col("d")).cast("int").alias("distance"))


@query("p9_moved_rows", f"""WITH {MIGRATED_SQL}
SELECT id, filename, original, new FROM crossed WHERE moved""")
def moved_rows(spark, folder):
    moves = _migrations(spark, folder)
    return moves.where(migration.moved(F.col("original"), F.col("new"))).drop("label")


@query("s4_split_manifest", f"""WITH {ASSIGNED_SQL},
named AS (SELECT a.id, a.split, a.label, d.source || '/' || a.id || '/scan_' || d.n_chars
    || '.jpg' AS path, 'scan_' || d.n_chars AS stem
  FROM assigned a JOIN docs d USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split, label, stem
  ORDER BY md5('0|' || path)) - 1 AS k FROM named)
SELECT id, path, split || '/' || label || '/' || stem || CASE WHEN k > 0 THEN '_' || k ELSE '' END
  || '.jpg' AS destination FROM ranked""")
def split_manifest(spark, folder):
    path = F.concat("source", F.lit("/"), "id", F.lit("/scan_"), "n_chars", F.lit(".jpg"))
    files = documents(spark, folder).select("id", path.alias("path"))
    rows = assigned(spark, folder).select("id", "split", "label").join(files, "id")
    return images.split_manifest(rows).select("id", "path", "destination")


@query("s4_pruned_read", f"""WITH {ASSIGNED_SQL},
shares AS (SELECT label, count(*) AS n FROM assigned WHERE split = 'val' GROUP BY label),
wanted AS (SELECT label FROM shares WHERE n = (SELECT max(n) FROM shares))
SELECT id, label, split FROM assigned
WHERE split = 'val' AND label IN (SELECT label FROM wanted)""")
def pruned_read(spark, folder):
    """The largest validation class, read back from split folders by a join that prunes them."""
    place = scratch_path(spark, "split-folders")
    images.write_split(assigned(spark, folder).select("id", "label", "split"), place)
    counts = written(images.read_split(spark, place, ["val"]).groupBy("split", "label").agg(
        F.count("*").alias("n")), "val-counts")
    most = counts.agg(F.max("n").alias("n"))
    wanted = counts.join(F.broadcast(most), "n").select("split", "label")
    return images.read_split_of(spark, place, wanted).select("id", "label", "split")
