"""The operators of this package over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import (bpe, fmindex, packing, pages, periodic, pseudonyms, repetition, reputation, shallot, simhash, suffixes,
                           vptree, windows)

#: Key of the pseudonyms in queries; a deployment passes its own.
TEST_KEY = "key for tests"
#: The rules over page urls.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block")]


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, factor=1.0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.measure_repeats(_read(spark, sf_dir, "documents"), length=400)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_read(spark, sf_dir, "documents"), TEST_KEY)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, bad) of the pages whose document, numbered at the end of the url's path, is labelled."""
    labels = (_read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id")
              .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")))
    number = F.regexp_extract(reputation.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?$", 1)
    seen = _read(spark, sf_dir, "pages").select(reputation.host_of(F.col("url")).alias("host"), number.alias("number"))
    return seen.where("number != ''").join(labels, F.col("number").cast("long") == F.col("doc_id")).select("host", "bad")


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge_urls(_read(spark, sf_dir, "pages"), outcomes(spark, sf_dir), URL_RULES)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *(c for c in repetition.COLUMNS if c != "longest_repeat"), "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer(), capacity=2048, end_id=1)


def op7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeats(_read(spark, sf_dir, "documents"), n=20, texts=False)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_read(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), tokenizer())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=4, threshold=4)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the texts of a tenth of the ids go on with copies of some words, from one word on."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    chosen = (docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
              .withColumn("n", n.cast("long")).withColumn("a", F.when(n > 0, F.col("g") % F.col("n")))
              .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    again = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - F.col("a") - 1) / F.col("p"))),
                                  lambda _: F.slice("words", F.col("a") + 1, F.col("p"))))
    said = F.concat(F.slice("words", 1, F.col("a")), F.slice(again, 1, F.col("n") - F.col("a")))
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(said, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(planted(_read(spark, sf_dir, "documents")))).drop("n_words")


def op12_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shallot.cluster(_read(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, seed=1)
    return found.withColumn("centroid_sha256", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)).drop("centroid")


def op13_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fmindex.build(_read(spark, sf_dir, "documents"))
    return fmindex.digests(fmindex.search(index, _read(spark, sf_dir, "benchmark"), n=10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_vptree, op2_suffix_dedup, op3_pseudonyms, op4_host_reputation, op5_repetition, op6_packing,
                            op7_windows, op8_main_text, op9_bpe, op10_simhash, op11_periodic_runs, op12_shallot, op13_fm_index)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_vptree": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
        p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score
              FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_host_reputation": r"""
        WITH cut AS (
          SELECT page_id, url,
            translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        o AS (SELECT host, bad FROM cut JOIN bad ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html|/)?$', 1), '') AS BIGINT) WHERE host <> ''),
        h0 AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, string_split(host, '.') AS l FROM o GROUP BY host),
        h1 AS (SELECT *, CASE WHEN len(l) >= 2 AND l[-2] IN ('co','com','org','net','ac','gov','edu') AND regexp_full_match(l[-1], '[a-z][a-z]') THEN 2 ELSE 1 END AS k FROM h0),
        h AS (SELECT host, n, bad, array_to_string(l[greatest(1, len(l) - k + 1):], '.') AS suffix, array_to_string(l[greatest(1, len(l) - k):], '.') AS domain FROM h1),
        d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, count(*) AS m, sum(bad * bad / n) AS s1, sum(n * n) AS n2 FROM h GROUP BY ALL),
        d AS (SELECT *, CASE WHEN m < 2 OR bad <= 0 OR bad >= n THEN 10.0
               WHEN ((s1 - bad * bad / n) - (m - 1) * (bad / n) * (1 - bad / n)) / nullif(n - n2 / n, 0) <= 0 THEN 1000.0
               ELSE greatest(1.0, least(1000.0, (bad / n) * (1 - bad / n) / (((s1 - bad * bad / n) - (m - 1) * (bad / n) * (1 - bad / n)) / nullif(n - n2 / n, 0)) - 1)) END AS strength FROM d0),
        s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, count(*) AS m, sum(bad * bad / n) AS s1, sum(n * n) AS n2 FROM d GROUP BY ALL),
        s AS (SELECT *, CASE WHEN m < 2 OR bad <= 0 OR bad >= n THEN 10.0
               WHEN ((s1 - bad * bad / n) - (m - 1) * (bad / n) * (1 - bad / n)) / nullif(n - n2 / n, 0) <= 0 THEN 1000.0
               ELSE greatest(1.0, least(1000.0, (bad / n) * (1 - bad / n) / (((s1 - bad * bad / n) - (m - 1) * (bad / n) * (1 - bad / n)) / nullif(n - n2 / n, 0)) - 1)) END AS strength FROM s0),
        w0 AS (SELECT sum(n) AS n, sum(bad) AS bad, count(*) AS m, sum(bad * bad / n) AS s1, sum(n * n) AS n2 FROM s),
        w AS (SELECT n, bad, CASE WHEN m < 2 OR bad <= 0 OR bad >= n THEN 10.0
               WHEN ((s1 - bad * bad / n) - (m - 1) * (bad / n) * (1 - bad / n)) / nullif(n - n2 / n, 0) <= 0 THEN 1000.0
               ELSE greatest(1.0, least(1000.0, (bad / n) * (1 - bad / n) / (((s1 - bad * bad / n) - (m - 1) * (bad / n) * (1 - bad / n)) / nullif(n - n2 / n, 0)) - 1)) END AS strength FROM w0),
        sr AS (SELECT s.suffix, s.strength, (s.bad + w.strength * w.bad / w.n) / (s.n + w.strength) AS rate FROM s, w),
        dr AS (SELECT d.domain, d.strength, (d.bad + sr.strength * sr.rate) / (d.n + sr.strength) AS rate FROM d JOIN sr USING (suffix)),
        post AS (SELECT host, h.bad + strength * rate AS a, h.n - h.bad + strength * (1 - rate) AS b FROM h JOIN dr USING (domain)),
        blocked AS (SELECT host FROM post WHERE a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5),
        ruled AS (SELECT page_id, host, path, CASE
            WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM cut)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
               WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op5_repetition": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
        pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        s AS (SELECT doc_id, i, CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END AS s8,
                     CASE WHEN i + 15 <= len(w) THEN array_to_string(w[i:i + 15], ' ') END AS s16,
                     CASE WHEN i + 50 <= len(w) THEN md5(array_to_string(w[i:i + 50], ' ')) END AS s51 FROM pos),
        c AS (SELECT doc_id, i, s8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s8) > 1 AS r8,
                     s16 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s16) > 1 AS r16,
                     s51 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s51) > 1 AS r51 FROM s),
        u AS (SELECT doc_id, i, bool_or(r8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8,
                     bool_or(r16) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS c16, r51 FROM c),
        m AS (SELECT doc_id, count(*) FILTER (c8) AS n_repeat_words, count(*) FILTER (c16) AS covered_words, bool_or(r51) AS long_repeat FROM u GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
        ld AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
               (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
               coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
               coalesce(covered_words, 0)::BIGINT AS covered_words,
               len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed,
               NOT (len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w))
                 AND 100 * coalesce(covered_words, 0) <= 20 * len(w) AND NOT coalesce(long_repeat, false) AS kept
        FROM d LEFT JOIN m USING (doc_id) LEFT JOIN ld USING (doc_id)""",
    "op7_windows": rf"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        s AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS s FROM pos),
        c AS (SELECT doc_id, i, word, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS r FROM s),
        u AS (SELECT doc_id, i, word, bool_or(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS x FROM c),
        k AS (SELECT doc_id, count(*) FILTER (x) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT x) AS kept FROM u GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op11_periodic_runs"] = rf"""
    WITH d0 AS (SELECT doc_id, {WORDS} AS w0, xor(list_reduce(list_prepend(4294967295::BIGINT,
                  list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b:
                  list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))),
                  4294967295::BIGINT) AS h FROM documents),
    d1 AS (SELECT *, h // 10 AS g, len(w0) AS n FROM d0),
    d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d1),
    d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
    d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w0 END AS w FROM d3),
    words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
    same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words AS x JOIN words AS y ON x.doc_id = y.doc_id AND x.word = y.word
             WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
    lags AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM isle GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, s, len, min(q) AS q FROM lags GROUP BY doc_id, s, len),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS k FROM runs),
    told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS said FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period,
           (1000 * len // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(said, '')) AS collapsed_sha256
    FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (doc_id)"""


def _rounds(rounds: int) -> str:
    """Assignments a0, a1 .. and centroids c1, c2 .. as SQL, from vectors v of kept and centroids c0."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""a{r} AS (SELECT vec_id, v, min(d) % 16 AS c, min(d) // 16 AS distance FROM (
            SELECT vec_id, kept.v, 16 * list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i])))::BIGINT
                   + c AS d FROM kept, c{r}) GROUP BY vec_id, v)""")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT c, place, sum(x)::BIGINT AS s, count(*) AS n FROM (
                SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY c, place),
              m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM s{r} GROUP BY c),
              c{r + 1} AS (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return ",\n".join(out)


ORACLES["op12_shallot"] = f"""
    WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 16),
    {_rounds(3)}
    SELECT vec_id, a3.c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia,
           (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON a3.c = c3.c"""

ORACLES["op13_fm_index"] = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    cut AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM cut),
    pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win)),
    hit AS (SELECT doc_id, i, x.k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM pos) AS x
            JOIN win ON x.k = win.k AND x.s = win.s),
    n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
