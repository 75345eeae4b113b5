"""DuckDB SQL for the named queries. ``_sql`` puts the common table expressions that a query names before it."""

from __future__ import annotations

import re

from ..functions.sketch import coefficients
from .queries import ASOF, ASOF_SECONDS, PAGE_TIER, SHOW, SINCE_DAYS

ELIGIBLE = "poison_check = 'pass' AND match_confidence >= 0.70 AND match_source <> 'network_disc'"
SAME = "a.tmdb_id IS NOT DISTINCT FROM b.tmdb_id AND a.season IS NOT DISTINCT FROM b.season AND a.episode IS NOT DISTINCT FROM b.episode"
GRAMS = "list_transform(range(1, len(w) - 1), lambda i: ('0x' || substr(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 8))::BIGINT)"
WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"


def _day(c: str) -> str:
    return f"strftime(DATE '1970-01-01' + (({c}) // 86400)::INTEGER, '%Y-%m-%d')"


_A, _B = coefficients()
_COEFFS = ", ".join(f"({i}, {int(x)}, {int(y)})" for i, (x, y) in enumerate(zip(_A, _B)))

CTES = {
    "contribution": f"""
      SELECT *, CASE WHEN {ELIGIBLE} AND id % 3 = 0 THEN received_at + 3600 END AS promoted_at FROM (
        SELECT event_id AS id, floor(epoch(ts))::BIGINT AS received_at, user_id::VARCHAR AS pseudonym,
               json_extract_string(props, '$.k')::BIGINT + 1 AS tmdb_id,
               CASE WHEN event_id % 10 <> 0 THEN (1 + (event_id // 10) % 2)::INT END AS season,
               CASE WHEN event_id % 10 <> 0 THEN (1 + (event_id // 20) % 5)::INT END AS episode,
               0.5::DOUBLE + ((event_id * 37) % 51) / 100.0::DOUBLE AS match_confidence,
               CASE event_type WHEN 'error' THEN 'network_disc' WHEN 'signup' THEN 'bootstrap' WHEN 'purchase' THEN 'engram_asr'
                    WHEN 'view' THEN 'engram_discdb' ELSE 'user_review' END AS match_source,
               CASE WHEN event_id % 17 = 0 THEN 'flag_conflict' WHEN event_id % 23 = 0 THEN 'pending' ELSE 'pass' END AS poison_check,
               user_id % 7 AS disc
        FROM events)""",
    "contributor": """
      SELECT pseudonym, min(received_at) AS first_seen, max(received_at) AS last_seen, count(*) AS contribution_count,
             max((pseudonym::BIGINT % 10 = 0)::INT) AS flagged, count(*) FILTER (poison_check = 'flag_conflict') AS flag_count
      FROM contribution GROUP BY pseudonym""",
    "latest": f"""
      SELECT * EXCLUDE rk FROM (SELECT *, rank() OVER (PARTITION BY tmdb_id, season, episode, pseudonym ORDER BY received_at DESC) AS rk
        FROM contribution WHERE {ELIGIBLE}) WHERE rk = 1""",
    "episode_votes": """
      SELECT tmdb_id, season, episode, count(*) AS n_rows, count(DISTINCT (l.pseudonym, coalesce(disc::VARCHAR, 'null'))) AS independent,
             avg(match_confidence) AS mean_confidence, bool_or(coalesce(u.flagged, 0) = 1) AS any_flagged, max(received_at) AS last_vote
      FROM latest l LEFT JOIN contributor u ON u.pseudonym = l.pseudonym GROUP BY tmdb_id, season, episode""",
    "canonical": """
      SELECT tmdb_id, season, episode,
             CASE WHEN independent >= 3 AND round(mean_confidence, 12) >= 0.85 AND NOT any_flagged THEN 'canonical' WHEN independent >= 2 THEN 'confirmed' ELSE 'candidate' END AS tier,
             independent AS unique_contributors, mean_confidence, last_vote AS promoted_at, n_rows
      FROM episode_votes WHERE NOT (independent = 1 AND any_flagged) AND season IS NOT NULL AND episode IS NOT NULL""",
    "sketch_meta": """
      SELECT tmdb_id, season, episode, (tmdb_id * 10 + episode)::INT AS hash_count,
             promoted_at + CASE WHEN (tmdb_id + episode) % 3 = 0 THEN 0 ELSE 60 END AS generated_at
      FROM canonical WHERE (tmdb_id + season + episode) % 5 <> 0""",
    "observation": "SELECT id AS contribution_id, ((id * 13) % 101) / 100.0::DOUBLE AS max_overlap_pct FROM contribution WHERE poison_check <> 'pending'",
    "shows": """
      SELECT tmdb_id, count(*) AS episodes, count(*) FILTER (tier = 'canonical') AS canonical, count(*) FILTER (tier = 'confirmed') AS confirmed,
             count(*) FILTER (tier = 'candidate') AS candidate, round(avg(mean_confidence), 9) AS avg_conf FROM canonical GROUP BY tmdb_id""",
    "named": """
      SELECT shows.*, coalesce(p_name, 'tmdb:' || tmdb_id) AS name FROM shows LEFT JOIN part ON p_partkey = tmdb_id AND p_partkey % 4 <> 0""",
    "disc": """
      SELECT o_orderkey AS id, floor(epoch(o_orderdate))::BIGINT AS received_at, (o_orderkey % 97)::VARCHAR AS pseudonym,
             md5((o_custkey * 2 + (o_orderkey % 7 = 0)::INT)::VARCHAR) AS disc_content_hash, o_custkey % 200 + 1 AS tmdb_id,
             'tv' AS content_type, 1 AS season, (o_orderkey % 97) % 10 = 0 AS flagged,
             list_transform(range(0, o_custkey % 3 + 1), lambda t: {'i': t, 'e': t + 1 + CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 1 ELSE 0 END,
               'c': 0.75::DOUBLE + ((o_orderkey * 7 + t * 3) % 26) / 100.0::DOUBLE, 'net': (o_orderkey + t) % 19 = 0}) AS titles
      FROM orders""",
    "disc_stats": """
      SELECT *, len(titles)::INT AS n_titles, list_sum(list_transform(titles, lambda t: t.c)) / len(titles) AS mean_conf,
             list_bool_or(list_transform(titles, lambda t: t.net)) AS network,
             sha256('[' || array_to_string(list_transform(titles, lambda t: '{"title_index":' || t.i || ',"assignment":"episode","season":1,"episode":' || t.e || '}'), ',') || ']') AS titles_digest
      FROM disc""",
    "disc_good": "SELECT *, NOT flagged AND NOT network AND round(mean_conf, 12) >= 0.70 AS eligible FROM disc_stats",
    "disc_kept": """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disc_content_hash, titles_digest, pseudonym ORDER BY received_at DESC, id DESC) AS rn
        FROM disc_good WHERE eligible) WHERE rn = 1""",
    "digest_groups": """
      SELECT disc_content_hash, titles_digest, count(*) AS voters, avg(mean_conf) AS mean_confidence,
             arg_max(id, (received_at, id)) AS representative_id FROM disc_kept GROUP BY ALL""",
    "winner": """
      SELECT * EXCLUDE rn, CASE WHEN base = 'canonical' AND coalesce(runner_up, 0) >= 2 THEN 'confirmed' ELSE base END AS tier,
             base = 'canonical' AND coalesce(runner_up, 0) >= 2 AS capped
      FROM (SELECT *, row_number() OVER w AS rn, lead(voters) OVER w AS runner_up,
                   CASE WHEN voters >= 3 AND round(mean_confidence, 12) >= 0.85 THEN 'canonical' WHEN voters >= 2 THEN 'confirmed' ELSE 'candidate' END AS base
            FROM digest_groups WINDOW w AS (PARTITION BY disc_content_hash ORDER BY voters DESC, round(mean_confidence, 12) DESC, titles_digest))
      WHERE rn = 1""",
    "disc_canonical": """
      SELECT w.disc_content_hash, g.tmdb_id, g.content_type, g.season, w.titles_digest, w.tier, w.voters AS unique_contributors,
             w.mean_confidence, g.n_titles FROM winner w JOIN disc_kept g ON g.id = w.representative_id""",
    "disc_hist": "SELECT least(19, floor(round(mean_confidence * 20, 9))::INT) AS bucket, count(*) AS n FROM disc_canonical GROUP BY bucket",
    "doc_words": f"SELECT doc_id, {WORDS} AS w FROM documents",
    "doc_hashes": f"SELECT doc_id, {GRAMS} AS hashes FROM doc_words",
    "catalogue": "SELECT (doc_id // 20 + 1)::BIGINT AS tmdb_id, ((doc_id % 20) // 10 + 1)::INT AS season, (doc_id % 10 + 1)::INT AS episode, hashes FROM doc_hashes",
    "query_words": f"SELECT item_id, {WORDS} AS w FROM benchmark",
    "query": f"SELECT item_id AS query_id, {GRAMS} AS hashes FROM query_words",
    "votes": """
      SELECT * FROM (
        SELECT id, pseudonym, tmdb_id, season, episode, unnest(hashes) AS h, unnest(range(len(hashes))) AS pos
        FROM latest JOIN doc_hashes ON doc_id = (tmdb_id * 20 + season * 10 + episode) % (SELECT greatest(count(*), 1) FROM documents)
        WHERE season IS NOT NULL)
      WHERE (pos + pseudonym::BIGINT) % 5 <> 0""",
    "vote_counts": "SELECT tmdb_id, season, episode, count(DISTINCT id) AS n_votes FROM votes GROUP BY ALL",
    "agreed": """
      SELECT c.* FROM (SELECT tmdb_id, season, episode, h, count(DISTINCT id) AS n FROM votes GROUP BY ALL) c
      JOIN vote_counts USING (tmdb_id, season, episode) WHERE n >= ceil(n_votes * 0.5)""",
    "consensus": """
      SELECT tmdb_id, season, episode, list(h ORDER BY pos) AS hashes FROM votes JOIN vote_counts USING (tmdb_id, season, episode) WHERE n_votes = 1 GROUP BY ALL
      UNION ALL
      SELECT tmdb_id, season, episode, list(h ORDER BY h) AS hashes FROM agreed JOIN vote_counts USING (tmdb_id, season, episode) WHERE n_votes > 1 GROUP BY ALL""",
    "consensus_rows": "SELECT tmdb_id, season, episode, tier, hashes FROM canonical JOIN consensus USING (tmdb_id, season, episode)",
    "coeff": f"SELECT i, a::UBIGINT AS a, b::UBIGINT AS b FROM (VALUES {_COEFFS}) t(i, a, b)",
    "cat_mixed": """
      SELECT tmdb_id, season, episode, xor(y, y >> 16) AS x FROM (
        SELECT tmdb_id, season, episode, (xor(x, x >> 13) * 3266489909) % 4294967296 AS y FROM (
          SELECT tmdb_id, season, episode, (xor(h, h >> 16) * 2246822507) % 4294967296 AS x FROM (
            SELECT DISTINCT tmdb_id, season, episode, unnest(hashes)::UBIGINT AS h FROM catalogue)))""",
    "cat_slots": """
      SELECT tmdb_id, season, episode, i, coalesce(min((x * a + b) % 4294967296), 4294967295) AS v
      FROM (SELECT c.tmdb_id, c.season, c.episode, x, i, a, b FROM catalogue c CROSS JOIN coeff LEFT JOIN cat_mixed m
            ON m.tmdb_id = c.tmdb_id AND m.season = c.season AND m.episode = c.episode) GROUP BY ALL""",
    "query_mixed": """
      SELECT query_id, xor(y, y >> 16) AS x FROM (
        SELECT query_id, (xor(x, x >> 13) * 3266489909) % 4294967296 AS y FROM (
          SELECT query_id, (xor(h, h >> 16) * 2246822507) % 4294967296 AS x FROM (
            SELECT DISTINCT query_id, unnest(hashes)::UBIGINT AS h FROM query)))""",
    "query_slots": """
      SELECT query_id, i, coalesce(min((x * a + b) % 4294967296), 4294967295) AS v
      FROM (SELECT q.query_id, x, i, a, b FROM query q CROSS JOIN coeff LEFT JOIN query_mixed m ON m.query_id = q.query_id) GROUP BY ALL""",
    "found": """
      SELECT query_id, tmdb_id, season, episode, count(*) / 128.0::DOUBLE AS jaccard FROM query_slots JOIN cat_slots USING (i, v) GROUP BY ALL""",
    "best": """
      SELECT * FROM (
        SELECT q.query_id, c.tmdb_id, c.season, c.episode, coalesce(jaccard, 0.0) AS jaccard,
               row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(jaccard, 0.0) DESC, c.tmdb_id, c.season, c.episode) AS rank
        FROM query q CROSS JOIN catalogue c LEFT JOIN found f
          ON f.query_id = q.query_id AND f.tmdb_id = c.tmdb_id AND f.season = c.season AND f.episode = c.episode) WHERE rank <= 8""",
    "best_hashes": "SELECT DISTINCT query_id, tmdb_id, season, episode, unnest(hashes) AS h FROM best JOIN catalogue USING (tmdb_id, season, episode)",
    "df": "SELECT query_id, h, count(*) AS df FROM best_hashes GROUP BY ALL",
    "n_docs": "SELECT query_id, count(*) AS n_docs FROM best GROUP BY ALL",
    "matched": """
      SELECT b.query_id, b.tmdb_id, b.season, b.episode, q.pos, q.h, bh.h IS NOT NULL AS member,
             ln((n_docs + 1)::DOUBLE / (coalesce(df, 1) + 1)) + 1 AS w
      FROM best b JOIN (SELECT query_id, unnest(hashes) AS h, unnest(range(len(hashes))) AS pos FROM query) q USING (query_id)
      JOIN n_docs USING (query_id) LEFT JOIN df ON df.query_id = b.query_id AND df.h = q.h
      LEFT JOIN best_hashes bh ON bh.query_id = b.query_id AND bh.tmdb_id = b.tmdb_id AND bh.season = b.season AND bh.episode = b.episode AND bh.h = q.h""",
    "runs": """
      SELECT query_id, tmdb_id, season, episode, sum(n) AS qualifying FROM (
        SELECT query_id, tmdb_id, season, episode, count(*) AS n FROM (
          SELECT *, pos - row_number() OVER (PARTITION BY query_id, tmdb_id, season, episode, member ORDER BY pos) AS island FROM matched)
        WHERE member GROUP BY query_id, tmdb_id, season, episode, island) WHERE n >= 3 GROUP BY ALL""",
    "scored": """
      SELECT query_id, tmdb_id, season, episode, o AS hash_overlap_pct, t AS temporal_coherence, r AS rarity_weighted_score,
             greatest(0.0, least(1.0, 0.5 * r + 0.3 * o + 0.2 * t)) AS combined_score
      FROM (SELECT s.*, hits / n::DOUBLE AS o, coalesce(qualifying, 0) / n::DOUBLE AS t FROM (
              SELECT query_id, tmdb_id, season, episode, count(*) AS n, count(*) FILTER (member) AS hits,
                     sum(CASE WHEN member THEN w ELSE 0 END) / sum(w) AS r FROM matched GROUP BY ALL) s
            LEFT JOIN runs USING (query_id, tmdb_id, season, episode))""",
    "claim": """
      SELECT tmdb_id * 100 + season * 10 + episode AS id, tmdb_id + tmdb_id % 2 * 1000 AS claim, season, episode, tmdb_id AS own,
             list_filter(hashes, lambda h, i: (i - 1) % 11 <> 0) AS hashes FROM catalogue""",
    "claim_mixed": """
      SELECT id, xor(y, y >> 16) AS x FROM (SELECT id, (xor(x, x >> 13) * 3266489909) % 4294967296 AS y FROM (
          SELECT id, (xor(h, h >> 16) * 2246822507) % 4294967296 AS x FROM (SELECT DISTINCT id, unnest(hashes)::UBIGINT AS h FROM claim)))""",
    "claim_slots": """
      SELECT id, i, coalesce(min((x * a + b) % 4294967296), 4294967295) AS v
      FROM (SELECT c.id, x, i, a, b FROM claim c CROSS JOIN coeff LEFT JOIN claim_mixed m ON m.id = c.id) GROUP BY ALL""",
    "claim_best": """
      SELECT * FROM (SELECT id, tmdb_id, season, episode, j, row_number() OVER (PARTITION BY id ORDER BY j DESC, tmdb_id, season, episode) AS rn FROM (
          SELECT s.id, c.tmdb_id, c.season, c.episode, count(*) / 128.0::DOUBLE AS j FROM claim_slots s JOIN cat_slots c USING (i, v) JOIN claim k ON k.id = s.id
          WHERE NOT (c.tmdb_id = k.claim AND c.season = k.season AND c.episode = k.episode) GROUP BY ALL)) WHERE rn = 1""",
    "claim_exact": """
      SELECT id, count(DISTINCT CASE WHEN hit THEN pos END) / count(DISTINCT pos)::DOUBLE AS exact FROM (
        SELECT q.id, q.pos, list_contains(c.hashes, q.h) AS hit
        FROM (SELECT id, unnest(hashes) AS h, unnest(range(len(hashes))) AS pos FROM claim) q
        JOIN claim_best b ON b.id = q.id AND b.j > 0.7 - 0.1 JOIN catalogue c ON c.tmdb_id = b.tmdb_id AND c.season = b.season AND c.episode = b.episode) GROUP BY id""",
    "screened": """
      SELECT k.id, round(coalesce(j, 0.0), 9) AS estimate, b.tmdb_id AS target_tmdb_id, b.season AS target_season, b.episode AS target_episode,
             round(coalesce(exact, CASE WHEN len(hashes) = 0 AND j > 0.7 - 0.1 THEN 0.0 END, j, 0.0), 9) AS overlap_pct, CASE WHEN exact > 0.7 THEN 'flag_conflict' ELSE 'pass' END AS poison_check
      FROM claim k LEFT JOIN claim_best b USING (id) LEFT JOIN claim_exact USING (id)""",
    "by_day": f"""
      SELECT {_day("received_at")} AS day, 'contributions' AS s, count(*) AS n FROM contribution GROUP BY ALL
      UNION ALL SELECT {_day("promoted_at")} AS day, tier AS s, count(*) AS n FROM canonical GROUP BY ALL""",
    "wide": """
      SELECT day, coalesce(sum(n) FILTER (s = 'contributions'), 0)::BIGINT AS contributions, coalesce(sum(n) FILTER (s = 'candidate'), 0)::BIGINT AS candidate,
             coalesce(sum(n) FILTER (s = 'confirmed'), 0)::BIGINT AS confirmed, coalesce(sum(n) FILTER (s = 'canonical'), 0)::BIGINT AS canonical
      FROM by_day GROUP BY day""",
    "running": """
      SELECT day, (sum(contributions) OVER w)::BIGINT AS contributions, (sum(candidate) OVER w)::BIGINT AS candidate, (sum(confirmed) OVER w)::BIGINT AS confirmed,
             (sum(canonical) OVER w)::BIGINT AS canonical FROM wide WINDOW w AS (ORDER BY day)""",
    "request": """
      SELECT id, CASE WHEN id % 41 = 0 THEN 'wire_format_version' WHEN id % 31 = 0 AND regexp_matches(substr(md5(pseudonym), 1, 8), '[a-f]') THEN 'pseudonym'
                      WHEN id % 37 = 0 THEN 'tmdb_id' WHEN id % 43 = 0 THEN 'season' WHEN id % 61 = 0 THEN 'client_version'
                      WHEN id % 47 = 0 THEN 'fingerprint_sha256_b64' WHEN id % 53 = 0 THEN 'match_confidence' WHEN id % 59 = 0 THEN 'match_source' END AS reason
      FROM contribution""",
    "keyed": "SELECT *, (id % 3)::VARCHAR AS sha FROM contribution",
    "retracted": """
      SELECT * FROM keyed a WHERE NOT EXISTS (SELECT 1 FROM keyed b WHERE (b.id % 5 = 0 OR b.tmdb_id % 9 = 0) AND b.pseudonym = a.pseudonym AND b.sha = a.sha
        AND """ + SAME + ")",
    "few": "SELECT * REPLACE (least(unique_contributors, 2) AS unique_contributors) FROM canonical",
    "undercounted": f"""
      SELECT a.tmdb_id, a.season, a.episode, a.tier, a.unique_contributors AS stored, b.actual FROM few a JOIN (
        SELECT tmdb_id, season, episode, count(DISTINCT pseudonym) AS actual FROM contribution WHERE {ELIGIBLE} GROUP BY ALL) b
      ON {SAME} WHERE a.unique_contributors < b.actual""",
    "queue": f"""
      SELECT tmdb_id, season, episode, min(received_at) AS oldest FROM contribution WHERE promoted_at IS NULL AND {ELIGIBLE}
        AND season IS NOT NULL AND episode IS NOT NULL GROUP BY ALL ORDER BY oldest, tmdb_id, season, episode LIMIT 30""",
    "stale": """
      SELECT c.tmdb_id, c.season, c.episode, c.tier, c.promoted_at FROM canonical c LEFT JOIN sketch_meta s USING (tmdb_id, season, episode)
      WHERE generated_at IS NULL OR generated_at <= c.promoted_at""",
    "pack_hashes": "SELECT tmdb_id, h, count(*) AS df FROM (SELECT DISTINCT tmdb_id, season, episode, unnest(hashes) AS h FROM consensus_rows WHERE tier = 'canonical') GROUP BY ALL",
}

_RELATIVE = f"""CASE WHEN received_at IS NULL OR received_at = 0 THEN '—' WHEN g < 60 THEN g || 's ago' WHEN g < 3600 THEN g // 60 || 'm ago'
  WHEN g < 86400 THEN g // 3600 || 'h ago' WHEN g < 2592000 THEN g // 86400 || 'd ago' ELSE {_day("received_at")} END"""

FINAL = {
    "total_contributions": "SELECT count(*) AS n FROM contribution",
    "poison_breakdown": "SELECT poison_check, count(*) AS n FROM contribution WHERE promoted_at IS NULL GROUP BY poison_check",
    "unpromoted": "SELECT count(*) AS n FROM contribution WHERE promoted_at IS NULL AND poison_check = 'pass' AND match_confidence >= 0.70",
    "tier_breakdown": "SELECT tier, count(*) AS n FROM canonical GROUP BY tier",
    "total_episodes": "SELECT count(*) AS n FROM canonical",
    "distinct_shows": "SELECT count(DISTINCT tmdb_id) AS n FROM canonical",
    "shows_with_canonical": "SELECT count(DISTINCT tmdb_id) AS n FROM canonical WHERE tier = 'canonical'",
    "total_contributors": "SELECT count(*) AS n FROM contributor",
    "flagged_contributor_count": "SELECT count(*) AS n FROM contributor WHERE flagged = 1",
    "confidence_by_tier": "SELECT tier, round(avg(mean_confidence), 9) AS avg_conf, round(min(mean_confidence), 9) AS min_conf, round(max(mean_confidence), 9) AS max_conf FROM canonical GROUP BY tier",
    "contributions_by_day": f"SELECT {_day('received_at')} AS day, count(*) AS n FROM contribution GROUP BY ALL",
    "episodes_by_tier_by_day": f"SELECT {_day('promoted_at')} AS day, tier, count(*) AS n FROM canonical GROUP BY ALL",
    "match_source_breakdown": "SELECT match_source, count(*) AS n FROM contribution GROUP BY match_source",
    "overlap_stats": "SELECT count(*) AS n, round(coalesce(avg(max_overlap_pct), 0), 9) AS avg_overlap, round(coalesce(max(max_overlap_pct), 0), 9) AS max_overlap FROM observation",
    "top_shows": "SELECT * FROM shows ORDER BY episodes DESC, canonical DESC, tmdb_id LIMIT 20",
    "top_contributors": "SELECT * REPLACE (substr(pseudonym, 1, 8) AS pseudonym) FROM (SELECT * FROM contributor ORDER BY contribution_count DESC, contributor.pseudonym LIMIT 20)",
    "recent_contributions": f"""
      SELECT id, received_at, tmdb_id, season, episode, match_source, match_confidence, poison_check, promoted_at IS NOT NULL AS promoted,
             CASE WHEN season IS NULL THEN '—' ELSE 'S' || lpad(season::VARCHAR, 2, '0') || 'E' || lpad(episode::VARCHAR, 2, '0') END AS label, {_RELATIVE} AS age
      FROM (SELECT *, greatest(0, {ASOF_SECONDS} - received_at) AS g FROM contribution ORDER BY received_at DESC, id LIMIT 25)""",
    "disc_total_contributions": "SELECT count(*) AS n FROM disc",
    "disc_unique_discs": "SELECT count(DISTINCT disc_content_hash) AS n FROM disc",
    "disc_tier_breakdown": "SELECT tier, count(*) AS n FROM winner GROUP BY tier",
    "disc_confidence_dist": "SELECT * FROM disc_hist",
    "disc_top_shows": """SELECT tmdb_id, count(DISTINCT disc_content_hash) AS discs, count(*) AS contributions, count(DISTINCT pseudonym) AS contributors
      FROM disc GROUP BY tmdb_id ORDER BY discs DESC, contributions DESC, tmdb_id LIMIT 20""",
    "flagged_activity": """SELECT count(*) AS total, count(*) FILTER (poison_check = 'pass') AS passed, count(*) FILTER (promoted_at IS NOT NULL) AS promoted
      FROM contribution c JOIN contributor u ON u.pseudonym = c.pseudonym WHERE u.flagged = 1""",
    "shows_list": "SELECT * FROM named",
    "find_shows": "SELECT tmdb_id, name, episodes FROM named WHERE contains(lower(name), 'ring') OR contains('tmdb:' || tmdb_id, 'ring')",
    "show_detail": f"""
      SELECT c.season, c.episode, tier, round(mean_confidence, 9) AS mean_confidence, unique_contributors, promoted_at, coalesce(hash_count, 0) AS hash_count, coalesce(n, 0) AS contributions
      FROM canonical c LEFT JOIN sketch_meta s USING (tmdb_id, season, episode)
      LEFT JOIN (SELECT season, episode, count(*) AS n FROM contribution WHERE tmdb_id = {SHOW} GROUP BY ALL) x ON x.season = c.season AND x.episode = c.episode WHERE tmdb_id = {SHOW}""",
    "show_tier_summary": f"SELECT tier, count(*) AS n, round(avg(mean_confidence), 9) AS avg_conf FROM canonical WHERE tmdb_id = {SHOW} GROUP BY tier",
    "tier_page": f"""
      SELECT c.tmdb_id, c.season, c.episode, round(mean_confidence, 9) AS mean_confidence, unique_contributors, c.promoted_at, coalesce(hash_count, 0) AS hash_count, count(*) OVER () = 50 AS has_more
      FROM (SELECT * FROM canonical WHERE tier = '{PAGE_TIER}' ORDER BY tmdb_id, season, episode LIMIT 50 OFFSET 20) c LEFT JOIN sketch_meta USING (tmdb_id, season, episode)""",
    "undercounted_episodes": "SELECT * FROM undercounted",
    "growth_cumulative": "SELECT * FROM running",
    "growth_windowed": "SELECT * FROM running WHERE day >= '2024-01-20' OR (SELECT max(day) FROM running) < '2024-01-20'",
    "growth_daily": "SELECT * FROM wide",
    "trailing_window_sum": f"SELECT coalesce(sum(n) FILTER (day >= strftime(DATE '{ASOF}' - {SINCE_DAYS}, '%Y-%m-%d')), 0)::BIGINT AS n FROM by_day WHERE s = 'contributions'",
    "episode_grid": """
      SELECT g.tmdb_id, g.season, g.episode, coalesce(tier, 'missing') AS tier
      FROM (SELECT tmdb_id, season, unnest(range(1, max(episode) + 1))::INT AS episode FROM canonical GROUP BY tmdb_id, season) g LEFT JOIN canonical USING (tmdb_id, season, episode)""",
    "confidence_histogram_filled": """
      SELECT b::INT AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS b FROM disc_hist) LEFT JOIN disc_hist ON bucket = b""",
    "verdict_share": """
      SELECT v AS poison_check, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(1, (SELECT count(*) FROM contribution))::DOUBLE, 9) AS share
      FROM (VALUES ('pass'), ('pending'), ('flag_conflict'), ('flag_duplicate')) t(v) LEFT JOIN (SELECT poison_check, count(*) AS n FROM contribution GROUP BY ALL) ON poison_check = v""",
    "funnel_shares": """
      SELECT c AS contributions, e AS episodes, round(p / nullif(c, 0)::DOUBLE, 9) AS pass_rate, round(a / greatest(1, e)::DOUBLE, 9) AS candidate_share,
             round(b / greatest(1, e)::DOUBLE, 9) AS confirmed_share, round(k / greatest(1, e)::DOUBLE, 9) AS canonical_share
      FROM (SELECT count(*) AS c, count(*) FILTER (poison_check = 'pass') AS p FROM contribution),
           (SELECT count(*) AS e, count(*) FILTER (tier = 'candidate') AS a, count(*) FILTER (tier = 'confirmed') AS b, count(*) FILTER (tier = 'canonical') AS k FROM canonical)""",
    "promotion_queue": "SELECT * FROM queue",
    "promotion_cursor": f"""
      SELECT CASE WHEN promoted_at IS NOT NULL THEN promoted_at = {ASOF_SECONDS} WHEN {ELIGIBLE} AND EXISTS (SELECT 1 FROM queue b WHERE {SAME}) THEN true END AS stamped_now, count(*) AS n
      FROM contribution a GROUP BY ALL""",
    "unpromotable_episodes": f"SELECT DISTINCT tmdb_id, season, episode FROM contribution WHERE ({ELIGIBLE}) AND (season IS NULL OR episode IS NULL)",
    "latest_votes": "SELECT id, pseudonym, tmdb_id, season, episode, received_at FROM latest",
    "episode_votes": "SELECT * REPLACE (round(mean_confidence, 9) AS mean_confidence) FROM episode_votes",
    "episode_tiers": "SELECT * REPLACE (round(mean_confidence, 9) AS mean_confidence) FROM canonical",
    "consensus_hashes": "SELECT tmdb_id, season, episode, count(*) AS n_hashes, sum(n)::BIGINT AS n_votes, sum(h)::BIGINT AS sum_h FROM agreed GROUP BY ALL",
    "consensus_canonical": "SELECT tmdb_id, season, episode, tier, len(hashes)::INT AS n_hashes, md5(array_to_string(hashes, ',')) AS fingerprint_md5 FROM consensus_rows",
    "disc_title_stats": "SELECT id, n_titles, round(mean_conf, 9) AS mean_conf, network, eligible FROM disc_good",
    "disc_digest_groups": "SELECT disc_content_hash, titles_digest, voters, round(mean_confidence, 9) AS mean_confidence, representative_id FROM digest_groups",
    "disc_winner": "SELECT disc_content_hash, titles_digest, voters, runner_up, tier, capped FROM winner",
    "disc_canonical": "SELECT disc_content_hash, tmdb_id, content_type, season, titles_digest, tier, unique_contributors, round(mean_confidence, 9) AS mean_confidence FROM disc_canonical",
    "titles_digest": "SELECT id, titles_digest FROM disc_stats",
    "minhash_sketch": """
      SELECT tmdb_id, season, episode, len(hashes)::INT AS hash_count, md5(s) AS sketch_md5 FROM catalogue JOIN (
        SELECT tmdb_id, season, episode, string_agg(v::VARCHAR, ',' ORDER BY i) AS s FROM cat_slots GROUP BY ALL) USING (tmdb_id, season, episode)""",
    "jaccard_topn": "SELECT query_id, tmdb_id, season, episode, jaccard, rank::INT AS rank FROM best",
    "exact_overlap": "SELECT query_id, tmdb_id, season, episode, round(hash_overlap_pct, 9) AS hash_overlap_pct FROM scored",
    "document_frequency": "SELECT h, count(*) AS df FROM (SELECT DISTINCT tmdb_id, season, episode, unnest(hashes) AS h FROM catalogue) GROUP BY h",
    "rarity_overlap": "SELECT query_id, tmdb_id, season, episode, round(rarity_weighted_score, 9) AS rarity_weighted_score FROM scored",
    "temporal_coherence": "SELECT query_id, tmdb_id, season, episode, round(temporal_coherence, 9) AS temporal_coherence FROM scored",
    "identify": """
      SELECT * FROM (
        SELECT query_id, tmdb_id, season, episode, round(hash_overlap_pct, 9) AS hash_overlap_pct, round(temporal_coherence, 9) AS temporal_coherence,
               round(rarity_weighted_score, 9) AS rarity_weighted_score, round(combined_score, 9) AS combined_score,
               row_number() OVER (PARTITION BY query_id ORDER BY round(combined_score, 9) DESC, tmdb_id, season, episode)::INT AS rank,
               CASE episode % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'confirmed' ELSE 'candidate' END AS tier
        FROM scored WHERE round(combined_score, 9) >= 0.15) WHERE rank <= 5""",
    "identify_disc": """
      SELECT disc_content_hash, tmdb_id, tier, unique_contributors, n_titles FROM (
        SELECT DISTINCT disc_content_hash FROM disc UNION ALL SELECT md5('unknown' || i::VARCHAR) FROM range(10) t(i)) LEFT JOIN disc_canonical USING (disc_content_hash)""",
    "anti_poison_screen": "SELECT id, estimate, target_tmdb_id, target_season, target_episode FROM screened",
    "anti_poison_verdict": "SELECT id, overlap_pct, poison_check FROM screened",
    "valid_contributions": "SELECT id FROM request WHERE reason IS NULL",
    "rejected_contributions": "SELECT id, reason FROM request WHERE reason IS NOT NULL",
    "dedupe_contributions": f"""
      SELECT a.id, CASE WHEN old IS NULL AND rn = 1 THEN 'new' ELSE 'flag_duplicate' END AS status, CASE WHEN old IS NULL AND rn = 1 THEN a.id ELSE coalesce(old, first) END AS contribution_id
      FROM (SELECT *, row_number() OVER w AS rn, first_value(id) OVER w AS first FROM keyed WHERE id % 4 <> 0 WINDOW w AS (PARTITION BY pseudonym, tmdb_id, season, episode, sha ORDER BY received_at, id)) a
      LEFT JOIN (SELECT pseudonym, tmdb_id, season, episode, sha, min(id) AS old FROM keyed WHERE id % 4 = 0 GROUP BY ALL) b ON a.pseudonym = b.pseudonym AND a.sha = b.sha AND {SAME}""",
    "contributor_rollup": "SELECT pseudonym, first_seen, last_seen, contribution_count, (flag_count > 3)::INT AS flagged, flag_count FROM contributor",
    "flagged_contributors": "SELECT pseudonym, flag_count FROM contributor WHERE flag_count > 3",
    "rate_limited": "SELECT * FROM (SELECT id, pseudonym, row_number() OVER (PARTITION BY pseudonym, received_at // 86400 ORDER BY received_at, id)::INT AS nth FROM contribution) WHERE nth > 2",
    "stale_sketches": "SELECT tmdb_id, season, episode, tier FROM stale",
    "sketch_batch": """SELECT tmdb_id, season, episode, tier FROM (SELECT * FROM stale
      ORDER BY CASE tier WHEN 'canonical' THEN 0 WHEN 'confirmed' THEN 1 ELSE 2 END, promoted_at, tmdb_id, season, episode LIMIT 100)""",
    "forget": """
      SELECT 'contribution' AS table_name, count(*) AS n_left FROM contribution WHERE pseudonym::BIGINT % 6 <> 1
      UNION ALL SELECT 'contributor', count(*) FROM contributor WHERE pseudonym::BIGINT % 6 <> 1
      UNION ALL SELECT 'overlap_observation', count(*) FROM observation JOIN contribution ON id = contribution_id WHERE pseudonym::BIGINT % 6 <> 1""",
    "retract_rederive": f"""
      SELECT a.tmdb_id, a.season, a.episode, n_before - coalesce(n_after, 0) AS deleted, coalesce(n_after, 0) AS remaining,
             CASE WHEN coalesce(n_after, 0) > 0 THEN 're_derived' ELSE 'removed' END AS outcome
      FROM (SELECT tmdb_id, season, episode, count(*) AS n_before FROM keyed GROUP BY ALL) a
      LEFT JOIN (SELECT tmdb_id, season, episode, count(*) AS n_after FROM retracted GROUP BY ALL) b ON {SAME} WHERE coalesce(n_after, 0) < n_before""",
    "orphan_canonical": f"SELECT tmdb_id, season, episode FROM canonical a WHERE NOT EXISTS (SELECT 1 FROM contribution b WHERE b.tmdb_id % 3 <> 0 AND {SAME})",
    "backfill_reset": f"SELECT id, coalesce(CASE WHEN NOT EXISTS (SELECT 1 FROM undercounted b WHERE {SAME}) THEN promoted_at END, 0) AS promoted_at FROM contribution a",
    "pack_df": "SELECT tmdb_id, count(*) AS n_hashes, sum(df)::BIGINT AS sum_df, max(df) AS max_df FROM pack_hashes GROUP BY tmdb_id",
    "contribute_path": """
      SELECT pseudonym, count(*) AS contribution_count, count(*) FILTER (poison_check = 'flag_conflict') AS flag_count,
             (count(*) FILTER (poison_check = 'flag_conflict') > 3)::INT AS flagged, count(*) AS observations, max(overlap_pct) AS max_overlap, count(*) AS duplicates
      FROM (SELECT ((id // 100) % 13)::VARCHAR AS pseudonym, overlap_pct, poison_check FROM screened) GROUP BY pseudonym""",
    "disc_dedupe": """
      SELECT a.id, CASE WHEN old IS NULL AND rn = 1 THEN a.id ELSE coalesce(old, first) END AS contribution_id
      FROM (SELECT x.id, x.pseudonym, x.disc_content_hash, s.titles_digest, row_number() OVER w AS rn, first_value(x.id) OVER w AS first
            FROM disc x JOIN disc_stats s ON s.id = x.id WHERE x.id % 4 <> 0
            WINDOW w AS (PARTITION BY x.pseudonym, x.disc_content_hash, s.titles_digest ORDER BY x.received_at, x.id)) a
      LEFT JOIN (SELECT x.pseudonym, x.disc_content_hash, s.titles_digest, min(x.id) AS old FROM disc x JOIN disc_stats s ON s.id = x.id WHERE x.id % 4 = 0 GROUP BY ALL) b
      ON a.pseudonym = b.pseudonym AND a.disc_content_hash = b.disc_content_hash AND a.titles_digest = b.titles_digest""",
    "disc_unpromoted": "SELECT DISTINCT disc_content_hash FROM disc WHERE id % 3 <> 0",
    "disc_stamped": f"SELECT id, CASE WHEN id % 3 = 0 THEN received_at + 86400 ELSE {ASOF_SECONDS} END AS promoted_at FROM disc",
    "sketch_refresh": """
      SELECT tmdb_id, season, episode, len(hashes)::INT AS hash_count FROM consensus_rows SEMI JOIN stale USING (tmdb_id, season, episode)
      UNION ALL SELECT tmdb_id, season, episode, hash_count FROM sketch_meta ANTI JOIN (
        SELECT tmdb_id, season, episode FROM consensus_rows SEMI JOIN stale USING (tmdb_id, season, episode)) USING (tmdb_id, season, episode)""",
    "retract_outcome": f"""
      SELECT outcome, count(*) AS n, sum(deleted)::BIGINT AS deleted, sum(remaining)::BIGINT AS remaining FROM (
        SELECT deleted, coalesce(b.n, 0) AS remaining, CASE WHEN deleted = 0 THEN 'untouched' WHEN coalesce(b.n, 0) > 0 THEN 're_derived' ELSE 'removed' END AS outcome
        FROM (SELECT pseudonym, tmdb_id, season, episode, sha, count(*) AS deleted FROM keyed k
                WHERE NOT EXISTS (SELECT 1 FROM retracted r WHERE r.id = k.id) GROUP BY ALL
              UNION ALL SELECT DISTINCT pseudonym, tmdb_id, season, episode, 'none', 0 FROM keyed WHERE id % 7 = 0) a
        LEFT JOIN (SELECT tmdb_id, season, episode, count(*) AS n FROM retracted GROUP BY ALL) b ON {SAME}) GROUP BY outcome""",
    "upsert_episodes": """
      SELECT tmdb_id, season, episode, tier, CASE WHEN episode = 1 THEN 0 ELSE unique_contributors END AS unique_contributors FROM canonical
      UNION ALL SELECT tmdb_id + 100000, season, episode, tier, 0 FROM canonical WHERE episode = 1""",
    "seed_episodes": """
      SELECT tmdb_id, season, episode, CASE WHEN tmdb_id % 2 = 0 THEN 'canonical' ELSE tier END AS tier, unique_contributors FROM canonical
      UNION ALL SELECT tmdb_id + 100000, season, episode, 'canonical', 1 FROM canonical WHERE tmdb_id % 2 = 0""",
    "orphans_removed": f"""
      SELECT count(*) AS n FROM canonical a WHERE EXISTS (SELECT 1 FROM contribution b WHERE b.tmdb_id % 3 <> 0 AND {SAME})
      UNION ALL SELECT count(*) FROM sketch_meta a WHERE EXISTS (SELECT 1 FROM contribution b WHERE b.tmdb_id % 3 <> 0 AND {SAME})""",
    "disc_requests": """
      SELECT id, CASE WHEN id % 41 = 0 THEN 'wire_format_version' WHEN id % 37 = 0 THEN 'tmdb_id' WHEN id % 31 = 0 THEN 'disc_content_hash_b64' WHEN id % 43 = 0 THEN 'content_type'
                      WHEN id % 47 = 0 THEN 'titles' WHEN id % 53 = 0 THEN 'title' END AS reason FROM disc""",
    "small_requests": """
      SELECT pseudonym, CASE WHEN i % 7 = 0 THEN 'wire_format_version' WHEN i % 5 = 0 THEN 'pseudonym' END AS forget_reason,
             CASE WHEN i % 7 = 0 THEN 'wire_format_version' WHEN i % 5 = 0 THEN 'pseudonym' WHEN i % 3 = 0 THEN 'tmdb_id' WHEN i % 11 = 0 THEN 'fingerprint_sha256_b64' END AS retract_reason
      FROM (SELECT pseudonym, pseudonym::BIGINT AS i FROM contributor)""",
    "encodings": """
      SELECT id, md5('[' || string_agg('{"title_index":' || t || ',"duration_seconds":' || 1200 + t * 60 || ',"size_bytes":' || t * 1000000 || ',"assignment":"episode","season":1,"episode":'
               || t + 1 + shift || ',"match_confidence":' || (0.75::DOUBLE + ((id * 7 + t * 3) % 26) / 100.0::DOUBLE)::VARCHAR || ',"match_source":"' || source || '"}', ',' ORDER BY t) || ']') AS titles_md5,
             count(*)::INT AS n_titles, any_value(disc_content_hash) AS disc_hex
      FROM (SELECT o_orderkey AS id, unnest(range(o_custkey % 3 + 1)) AS t, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 1 ELSE 0 END AS shift,
                   md5((o_custkey * 2 + (o_orderkey % 7 = 0)::INT)::VARCHAR) AS disc_content_hash FROM orders) x
      CROSS JOIN LATERAL (SELECT CASE WHEN (id + t) % 19 = 0 THEN 'network_disc' ELSE 'engram_discdb' END AS source) y GROUP BY id""",
    "jaccard_estimate": "SELECT query_id, tmdb_id, season, episode, jaccard FROM best",
    "sparkline": "SELECT day, n, (sum(n) OVER (ORDER BY day))::BIGINT AS total FROM by_day WHERE s = 'contributions'",
    "show_ids_union": "SELECT tmdb_id FROM canonical UNION SELECT tmdb_id FROM contribution UNION SELECT tmdb_id FROM disc",
}


def _again(suffix: str, first: str, sql: str, *rest: str) -> None:
    """The common table expressions ``first`` and ``rest`` once more under names with ``suffix``, the first as ``sql``."""
    names = (first, *rest)
    for n in names:
        text = sql if n == first else CTES[n]
        CTES[n + suffix] = text if n == first else re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(names)})\b", rf"\1\2\3{suffix}", text)


CTES["asked"] = f"SELECT DISTINCT pseudonym, tmdb_id, season, episode, sha FROM keyed WHERE id % 5 = 0 OR (tmdb_id % 4 = 0 AND {ELIGIBLE})"
CTES["spared"] = f"SELECT a.* FROM keyed a WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE a.pseudonym = b.pseudonym AND a.sha = b.sha AND {SAME})"
_again("_left", "latest", CTES["latest"].replace("FROM contribution", "FROM spared"), "episode_votes", "canonical")
_again("_flagged", "disc", """
      SELECT disc.* REPLACE (coalesce(u.flagged = 1, false) AS flagged) FROM disc LEFT JOIN contributor u ON u.pseudonym = disc.pseudonym
      WHERE disc_content_hash < '8'""", "disc_stats", "disc_good", "disc_kept", "digest_groups", "winner", "disc_canonical")
_again("_later", "votes", "SELECT * FROM votes WHERE id % 4 <> 0", "vote_counts", "agreed", "consensus")
FINAL |= {
    "retract_kept": f"""
      SELECT outcome, count(*) AS n, sum(deleted)::BIGINT AS deleted, sum(remaining)::BIGINT AS remaining FROM (
        SELECT deleted, coalesce(l.n, 0) AS remaining, CASE WHEN coalesce(l.n, 0) = 0 THEN 'removed' WHEN k.tmdb_id IS NULL THEN 'kept' ELSE 're_derived' END AS outcome
        FROM (SELECT a.tmdb_id, a.season, a.episode, count(*) AS deleted FROM keyed b JOIN asked a ON a.pseudonym = b.pseudonym AND a.sha = b.sha AND {SAME}
              GROUP BY a.pseudonym, a.tmdb_id, a.season, a.episode, a.sha) a
        LEFT JOIN (SELECT tmdb_id, season, episode, count(*) AS n FROM spared GROUP BY ALL) l ON {SAME.replace("b.", "l.")}
        LEFT JOIN canonical_left k ON {SAME.replace("b.", "k.")}) GROUP BY outcome""",
    "disc_rederived": """
      SELECT disc_content_hash, tmdb_id, content_type, season, titles_digest, tier, unique_contributors, round(mean_confidence, 9) AS mean_confidence
      FROM (SELECT * FROM disc_canonical_flagged UNION ALL SELECT * FROM disc_canonical o WHERE NOT EXISTS (SELECT 1 FROM disc_canonical_flagged n WHERE n.disc_content_hash = o.disc_content_hash))""",
    "forget_everywhere": FINAL["forget"] + " UNION ALL SELECT 'disc_contribution', count(*) FROM disc WHERE NOT EXISTS (SELECT 1 FROM contributor c WHERE c.pseudonym = disc.pseudonym AND c.pseudonym::BIGINT % 6 = 1)",
    "sketch_diff": """
      SELECT tmdb_id, season, episode, CASE WHEN i % 5 = 0 THEN 'missing' WHEN i % 7 = 0 OR i % 11 = 0 THEN 'changed' ELSE 'equal' END AS state,
             CASE WHEN i % 5 <> 0 THEN n + CASE WHEN i % 11 = 0 THEN 1 ELSE 0 END END::INT AS old_count, n::INT AS hash_count
      FROM (SELECT *, tmdb_id * 20 + season * 10 + episode AS i, len(hashes) AS n FROM catalogue)
      UNION ALL SELECT tmdb_id + 100000, season, episode, 'orphaned', (n + CASE WHEN i % 11 = 0 THEN 1 ELSE 0 END)::INT, NULL
      FROM (SELECT *, tmdb_id * 20 + season * 10 + episode AS i, len(hashes) AS n FROM catalogue) WHERE episode = 1 AND i % 5 <> 0""",
    "json_requests": "SELECT id, CASE WHEN id % 67 = 0 OR id % 71 = 0 THEN 'unreadable' ELSE reason END AS reason FROM request",
    "identify_requests": """
      SELECT request_id, status, rank, tmdb_id, season, episode, combined_score, tier
      FROM (SELECT query_id AS request_id, CASE WHEN query_id % 7 = 3 THEN 'missing fp' WHEN query_id % 11 = 5 OR query_id % 13 = 6 THEN 'invalid fingerprint payload' ELSE 'ok' END AS status,
                   CASE query_id % 4 WHEN 1 THEN 2 WHEN 3 THEN 20 ELSE 5 END AS k FROM query)
      LEFT JOIN (
        SELECT query_id, tmdb_id, season, episode, round(combined_score, 9) AS combined_score,
               row_number() OVER (PARTITION BY query_id ORDER BY round(combined_score, 9) DESC, tmdb_id, season, episode)::INT AS rank,
               CASE episode % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'confirmed' ELSE 'candidate' END AS tier
        FROM scored WHERE round(combined_score, 9) >= 0.15) f ON f.query_id = request_id AND status = 'ok' AND rank <= k""",
    "pack_objects": f"SELECT tmdb_id, tmdb_id || '.zstd' AS name, count(*)::VARCHAR AS n_episodes, '{ASOF_SECONDS}' AS generated_at FROM consensus_rows WHERE tier = 'canonical' GROUP BY tmdb_id",
    "escaped_names": """
      SELECT p_partkey AS tmdb_id, replace(replace(replace(replace(replace('<b title=' || chr(39) || '"x"' || chr(39) || '>&amp;' || p_name,
               '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS html
      FROM part WHERE p_partkey % 4 <> 0""",
    "consensus_deltas": "SELECT tmdb_id, season, episode, len(hashes)::INT AS n_hashes, md5(array_to_string(hashes, ',')) AS fingerprint_md5 FROM consensus_later",
    "varints": """
      SELECT tmdb_id, season, episode, coalesce(strlen(x) // 2, 0)::INT AS n_bytes, md5(coalesce(x, '')) AS hex_md5 FROM (
        SELECT tmdb_id, season, episode, array_to_string(list_transform(hashes, lambda h: array_to_string(list_transform(range(greatest(1, (length(bin(h)) + 6) // 7)),
                 lambda k: printf('%02X', (((h >> (7 * k)::INT) & 127) + CASE WHEN k + 1 < greatest(1, (length(bin(h)) + 6) // 7) THEN 128 ELSE 0 END)::BIGINT)), '')), '') AS x FROM catalogue)""",
}


def _sql(final: str) -> str:
    """The query behind its common table expressions, each after those it names."""
    order: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in order and re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b", text):
                need(CTES[name], name)
                if name not in order:
                    order.append(name)

    need(final)
    return f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in order)} {final}" if order else final


ORACLE = {name: _sql(final) for name, final in FINAL.items()}
