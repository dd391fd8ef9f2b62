"""The operators' registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.llm import bpe, chat, decontam, gam, html, langid, phrases, pii, repair, sharding, simhash, suffix, topk
from fixtura.llm.common import read

#: Labels are learned only where this remainder of the key's CRC is another one.
HELD_OUT = 2


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def held_out(key: str):
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % 4 == HELD_OUT, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> gam.Model:
    return gam.train(docs, read(spark, sf_dir, "labels").where(~held_out("doc_id")))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), *vocabulary())


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(read(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.conversations(chat.log(rows.unionByName(extra))))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = gam.score(docs.select("doc_id", "text"), quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= gam.CUT).cast("int").alias("predicted"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that other documents hold too: spans and extra spans (all but first occurrences) as start:end."""
    found = suffix.repeats(read(spark, sf_dir, "documents"), across=True)
    say = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), total("spans").alias("repeated_chars"), total("extra").alias("extra_chars"), say("spans").alias("spans"), say("extra").alias("extra"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs)).drop("text").withColumn("own", F.filter("spans", lambda s: s["base"]))
    say = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("own", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(say("own"), 256).alias("base_sha256"), say("spans").alias("spans"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(read(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs.where(~held_out("doc_id"))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_hilbert_shards, op3_simhash, op4_topk, op5_chat, op6_quality_gam, op7_suffix_array, op8_pii, op9_main_text, op10_decontamination, op11_structure_repair, op12_collocations, op13_language_id, pipeline)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the operator; the others are tested against brute force."""
    return {
        "op4_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op10_decontamination": r"""
            WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
            iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
            si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM iw WHERE len(w) > 0),
            n AS (SELECT item_id, count(*) AS n FROM si GROUP BY 1)
            SELECT doc_id, item_id, round(CAST(count(*) AS DOUBLE) / any_value(n), 6) AS containment
            FROM ds JOIN si USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)""",
        "op11_structure_repair": r"""
            WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                            string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS s FROM conversations),
            d AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(s, lambda c: list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
                         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) % 20 AS h FROM k),
            a AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                  unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
            o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM a),
            m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
            r AS MATERIALIZED (SELECT conv_id, turn, role, text, i, role[1:1] AS c, prior IS NOT NULL AND prior || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal,
                  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM m),
            g AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY conv_id),
            v(conv_id, i, v) AS (
              SELECT conv_id, n + 1, [0, 10, 5, 0] FROM g
              UNION ALL
              SELECT conv_id, i, [least(e0, 5 + e2, 10 + e3), least(e1, 5 + e2, 10 + e3), least(e2, 5 + e3), least(e3, 5 + e2)]
              FROM (SELECT conv_id, i, least(2 + v[1], m + CASE c WHEN 's' THEN v[2] ELSE 1000000 END, m + ku) AS e0, least(2 + v[2], m + ku) AS e1, least(2 + v[3], m + ka) AS e2, least(2 + v[4], m + ku) AS e3
                    FROM (SELECT r.conv_id, r.i, r.c, v.v, CASE fault WHEN 'b' THEN 1000000 WHEN 'd' THEN 1000000 WHEN 't' THEN 5 ELSE 0 END AS m,
                                 v.v[3] + CASE c WHEN 'u' THEN 0 ELSE 1 END AS ku, v.v[4] + CASE c WHEN 'a' THEN 0 ELSE 1 END AS ka
                          FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i - 1))),
            w(conv_id, i, q, audit, said) AS (
              SELECT conv_id, 1, 1, '', []::VARCHAR[] FROM g
              UNION ALL
              SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN keep ELSE nx END, audit || e,
                     CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, CASE nx WHEN 3 THEN 'user:' ELSE 'assistant:' END || text) ELSE list_append(said, CASE nx WHEN 3 THEN 'user:' ELSE 'assistant:' END) END
              FROM (SELECT w.conv_id, w.i, w.q, w.audit, w.said, r.role, r.text, x.keep, x.nx,
                           CASE WHEN r.i IS NOT NULL AND 2 + vn.v[w.q] = vi.v[w.q] THEN 'D' WHEN 5 + vi.v[x.nx] = vi.v[w.q] THEN 'I' WHEN r.i IS NULL THEN '' WHEN x.keep > 0 AND r.fault IN ('', 't') AND CASE r.fault WHEN 't' THEN 5 ELSE 0 END + vn.v[x.keep] = vi.v[w.q] THEN 'K' ELSE 'R' END AS e
                    FROM w JOIN v vi ON vi.conv_id IS NOT DISTINCT FROM w.conv_id AND vi.i = w.i LEFT JOIN v vn ON vn.conv_id IS NOT DISTINCT FROM w.conv_id AND vn.i = w.i + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
                         JOIN (VALUES (1, 's', 2, 3), (1, 'u', 3, 3), (1, 'a', 0, 3), (1, '', 0, 3), (2, 's', 0, 3), (2, 'u', 3, 3), (2, 'a', 0, 3), (2, '', 0, 3), (3, 's', 0, 4), (3, 'u', 0, 4), (3, 'a', 4, 4), (3, '', 0, 4), (4, 's', 0, 3), (4, 'u', 3, 3), (4, 'a', 0, 3), (4, '', 0, 3)) AS x(q, c, keep, nx)
                           ON x.q = w.q AND x.c = CASE WHEN r.c IN ('s', 'u', 'a') THEN r.c ELSE '' END)
              WHERE e <> ''),
            z AS (SELECT w.conv_id, w.audit, w.said, v.v[1] AS cost FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = g.n + 1 AND w.q IN (1, 4) JOIN v ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.i = 1)
            SELECT c.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated, coalesce(g.illegal, 0)::BIGINT AS illegal,
                   coalesce(z.cost, 0)::BIGINT AS cost, coalesce(z.audit, '') AS audit, sha256(coalesce(array_to_string(z.said, chr(10)), '')) AS repaired_sha256
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
        "op12_collocations": r"""
            WITH p AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda w: w <> '') AS w
                       FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
            g AS (SELECT lang, 1 AS k, unnest(w) AS p FROM p
                  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM p
                  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM p
                  UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) FROM p),
            e AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM g GROUP BY lang, k, p HAVING count(*) >= 30),
            n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
            c AS MATERIALIZED (SELECT lang, k, p, f, string_split(p, ' ') AS w FROM e WHERE k > 1),
            x AS (SELECT lang, k, p, f, w, unnest(range(1, k)) AS cut FROM c),
            y AS (SELECT lang, p, f, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:k], ' ') AS rp FROM x),
            s AS (SELECT y.lang, y.p, y.f, y.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * y.f) // (l.f::HUGEINT + r.f) AS score FROM y JOIN e l ON l.lang = y.lang AND l.p = y.lp JOIN e r ON r.lang = y.lang AND r.p = y.rp),
            b AS (SELECT lang, p, any_value(f) AS f, min({'score': score, 'cut': cut, 'l': l, 'r': r}) AS s FROM s GROUP BY lang, p),
            i AS (SELECT lang, f, unnest(list_transform(range(1, k), lambda i: array_to_string(w[i:i + 1], ' '))) AS p FROM c WHERE k > 2
                  UNION ALL SELECT lang, f, unnest([array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')]) FROM c WHERE k = 4),
            h AS (SELECT lang, p, max(f) AS f FROM i GROUP BY lang, p),
            t AS (SELECT b.lang, b.p AS phrase, b.f AS a, b.s.l AS l, b.s.r AS r, b.s.score::BIGINT AS score FROM b LEFT JOIN h ON h.lang = b.lang AND h.p = b.p WHERE h.f IS NULL OR 100::HUGEINT * h.f < 80::HUGEINT * b.f),
            o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
            SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
    }
