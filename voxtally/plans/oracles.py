"""Plain SQL for the registered queries, for a second engine to check them with.

Each statement is put together from named parts; the parts a query needs become its WITH clause.
"""

from __future__ import annotations

from voxtally.functions.text import WHITESPACE
from voxtally.operators.embed import FEATURES
from voxtally.plans import registry as reg
from voxtally.plans.views import DIMS, LEXICON
from voxtally.sources.lexicons import NOISE_LABEL, TOPIC_PREFIX

_SPACE = "".join(WHITESPACE)
_SPACE_CLASS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


def _values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )


def _cleaned(column: str) -> str:
    for pattern in LEXICON.clean_patterns:
        pattern = pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", _SPACE_CLASS)
        column = f"regexp_replace({column}, {_text(pattern)}, '', 'g')"
    return f"trim({column}, {_text(_SPACE)})"


_SYNONYM = "CASE word " + " ".join(
    f"WHEN {_text(k)} THEN {_text(v)}" for k, v in LEXICON.synonyms.items()
) + " ELSE word END"


def _tokens(source: str, low: bool = False, forms: str = "forms") -> str:
    drop = f"WHERE word NOT IN ({_list(LEXICON.neg_stopwords)})" if low else ""
    return f"""
    SELECT review_id, word, row_number() OVER (PARTITION BY review_id ORDER BY part, pos) AS ord
    FROM (
      SELECT review_id, word, 1 AS part, min(pos) AS pos FROM (
        SELECT review_id, {_SYNONYM} AS word, pos FROM (
          SELECT review_id, unnest(forms) AS word, generate_subscripts(forms, 1) AS pos FROM (
            SELECT review_id, regexp_extract_all(lower(content_clean), '[\\p{{L}}]{{2,}}') AS forms
            FROM {source}))
        WHERE word NOT IN ({_list(LEXICON.stop_words)}))
      GROUP BY review_id, word
      UNION ALL
      SELECT review_id, word, 0 AS part, pos FROM {source}
      JOIN dictionary ON contains(content_clean, word)
      WHERE NOT EXISTS (
        SELECT 1 FROM {forms} f WHERE f.review_id = {source}.review_id AND f.word = dictionary.word)
    ) {drop}"""


def _forms(source: str) -> str:
    return f"""
    SELECT DISTINCT review_id, {_SYNONYM} AS word FROM (
      SELECT review_id, unnest(regexp_extract_all(lower(content_clean), '[\\p{{L}}]{{2,}}')) AS word
      FROM {source})
    WHERE word NOT IN ({_list(LEXICON.stop_words)})"""


def _weights(
    tf: str,
    docs: str = "reviews_topic",
    root: str = "true",
    seeded: bool = False,
    binary: bool = False,
    min_df: int = reg.MIN_DF,
) -> str:
    n = "CAST(1 AS BIGINT)" if binary else "n"
    share = "n / total"
    share = f"CASE WHEN {root} THEN sqrt({share}) ELSE {share} END"
    boost = (
        f" * CASE WHEN term IN ({_list(LEXICON.seed_words())}) THEN 1.2 ELSE 1.0 END" if seeded else ""
    )
    return f"""
    SELECT topic, term, n, {share} * ln(1 + floor(sum_all / topics) / f){boost} AS weight
    FROM (
      SELECT *, sum(n) OVER (PARTITION BY topic) AS total, sum(n) OVER () AS sum_all FROM (
        SELECT topic, term, {n} AS n, count(*) OVER (PARTITION BY term) AS df,
               sum({n}) OVER (PARTITION BY term) AS f,
               (SELECT count(DISTINCT topic) FROM {docs}) AS topics
        FROM {tf})
      WHERE df >= {min_df} AND df <= 0.9 * topics)"""


def _top(weights: str) -> str:
    return f"""
    SELECT topic, CAST(rank AS INTEGER) AS rank, term, weight FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank
      FROM {weights}) WHERE rank <= 10"""


def _tf(topics: str, terms: str = "terms") -> str:
    return f"""
    SELECT topic, term, count(*) AS n FROM {topics} JOIN {terms} USING (review_id) GROUP BY topic, term"""


def _terms(tok: str) -> str:
    return f"""
    SELECT review_id, ord, 0 AS part, word AS term FROM {tok}
    UNION ALL
    SELECT review_id, ord, 1, word || ' ' || following FROM (
      SELECT *, lead(word) OVER (PARTITION BY review_id ORDER BY ord) AS following FROM {tok})
    WHERE following IS NOT NULL"""


def _hashed(tokens: str, docs: str, dims: int) -> str:
    """Unit vectors of hashed TF-IDF weights; ``tokens`` has a word per row."""
    return f"""
    SELECT review_id, list(CAST(coalesce(w / nullif(norm, 0), 0) AS FLOAT) ORDER BY bucket) AS embedding
    FROM (SELECT review_id, bucket FROM {docs}, (SELECT unnest(range({dims})) AS bucket))
    LEFT JOIN (
      SELECT review_id, bucket, n * idf AS w, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY review_id)) AS norm
      FROM (SELECT review_id, CAST(('0x' || substr(md5(word), 1, 4)) AS INTEGER) % {dims} AS bucket, count(*) AS n
            FROM {tokens} GROUP BY ALL)
      JOIN (SELECT bucket, ln(((SELECT count(*) FROM {docs}) + 1.0) / (count(*) + 1.0)) AS idf
            FROM (SELECT DISTINCT review_id, CAST(('0x' || substr(md5(word), 1, 4)) AS INTEGER) % {dims} AS bucket
                  FROM {tokens}) GROUP BY bucket) USING (bucket)
    ) USING (review_id, bucket) GROUP BY review_id"""


def _means(source: str, group: str) -> str:
    return f"""
    SELECT {group}, list(m ORDER BY i) AS vec FROM (
      SELECT {group}, i, avg(v) AS m FROM (
        SELECT {group}, CAST(unnest(embedding) AS DOUBLE) AS v,
               generate_subscripts(embedding, 1) AS i FROM {source})
      GROUP BY {group}, i) GROUP BY {group}"""


_SQUARES = " + ".join(f"(a.c{c} - b.c{c}) * (a.c{c} - b.c{c})" for c in range(5))


def _near(source: str) -> str:
    return f"""
    SELECT review_id, neighbor_id, distance,
           row_number() OVER (PARTITION BY review_id ORDER BY distance, neighbor_id) AS rank
    FROM (
      SELECT a.review_id, b.review_id AS neighbor_id, sqrt({_SQUARES}) AS distance
      FROM {source} a JOIN {source} b ON a.review_id <> b.review_id)"""


def _guided(docs: str, seed_vec: str) -> str:
    return f"""
    SELECT review_id, seed_id,
           list(CASE WHEN seed_id = -1 THEN v ELSE (3 * v + w) / 4 END ORDER BY i) AS g
    FROM (
      SELECT review_id, seed_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(vec) AS w,
             generate_subscripts(embedding, 1) AS i
      FROM (
        SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY sim DESC, seed_id) AS k FROM (
          SELECT review_id, embedding, t.seed_id, t.vec,
                 CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
                      THEN list_cosine_similarity(CAST(embedding AS DOUBLE[]), t.vec) ELSE 0 END AS sim
          FROM {docs}, (
            SELECT seed_id, vec FROM {seed_vec} UNION ALL
            SELECT -1, vec FROM ({_means(f"(SELECT 0 AS one, embedding FROM {docs})", "one")})) t))
      WHERE k = 1)
    GROUP BY review_id, seed_id"""


def _projected(source: str, key: str, vector: str) -> str:
    return f"""
    SELECT review_id, c, round(sum(v / norm * s) / sqrt(5), 6) + 0.0 AS v FROM (
      SELECT {key} AS review_id, CAST(unnest({vector}) AS DOUBLE) AS v,
             sqrt(list_dot_product(CAST({vector} AS DOUBLE[]), CAST({vector} AS DOUBLE[]))) AS norm,
             generate_subscripts({vector}, 1) - 1 AS d FROM {source})
    JOIN signs USING (d) GROUP BY review_id, c"""


def _sims(docs: str, centroids: str) -> str:
    return f"""
    SELECT review_id, r.topic AS own, c.topic,
           CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
                THEN greatest(list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec), 0) ELSE 0 END AS sim
    FROM {docs} r, {centroids} c"""


def _moved(docs: str, sims: str, trigger: float) -> str:
    return f"""
    SELECT r.review_id, r.brand, r.topic AS old_topic, coalesce(b.topic, r.topic) AS topic
    FROM {docs} r LEFT JOIN (
      SELECT review_id, topic FROM (
        SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY sim DESC, topic) AS k
        FROM {sims} WHERE own = -1 AND sim > 0)
      WHERE k = 1 AND (SELECT avg(CASE WHEN topic = -1 THEN 1.0 ELSE 0.0 END) FROM {docs}) > {trigger}
    ) b ON r.review_id = b.review_id"""


def _names(docs: str, top: str) -> str:
    return f"""
    SELECT topic, coalesce(string_agg(term, '_' ORDER BY rank), '{TOPIC_PREFIX}' || topic) AS topic_name
    FROM (SELECT DISTINCT topic FROM {docs} WHERE topic <> -1)
    LEFT JOIN (SELECT * FROM {top} WHERE rank <= 3) USING (topic) GROUP BY topic"""


def _counts(labelled: str) -> str:
    return f"""
    SELECT brand, topic_name, count(*) AS count FROM {labelled}
    WHERE topic <> -1 AND brand IS NOT NULL GROUP BY brand, topic_name"""


def _shares(counts: str) -> str:
    return f"""
    SELECT *, round_even(count / sum(count) OVER (PARTITION BY brand) * 100 * 10, 0) / 10 AS ratio
    FROM {counts}"""


def _top_five(shares: str) -> str:
    return f"""
    SELECT * FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY brand ORDER BY ratio DESC, topic_name) AS INTEGER) AS rank
      FROM {shares}) WHERE rank <= 5"""


_C, _H = reg.CLUSTER, reg.HIERARCHY


def _density(p: str, projected: str) -> dict[str, str]:
    """The parts of a density clustering, named with the prefix ``p``."""
    return {
        f"{p}reduced": "SELECT review_id, "
        + ", ".join(f"max(v) FILTER (c = {c}) AS c{c}" for c in range(5))
        + f" FROM {projected} GROUP BY review_id",
        f"{p}near": _near(f"{p}reduced"),
        f"{p}cores": f"""
    SELECT review_id, distance AS core FROM {p}near WHERE rank = {_C["min_samples"]}""",
        f"{p}eps": f"""
    SELECT min(core) AS eps FROM (
      SELECT core, count(*) OVER (ORDER BY core RANGE UNBOUNDED PRECEDING) AS upto FROM {p}cores)
    WHERE upto >= {_C["eps_quantile"]} * (SELECT count(*) FROM {p}cores)""",
        f"{p}links": f"""
    SELECT n.review_id AS a, n.neighbor_id AS b FROM {p}near n
    JOIN {p}cores x ON x.review_id = n.review_id JOIN {p}cores y ON y.review_id = n.neighbor_id, {p}eps
    WHERE n.rank <= {_C["n_neighbors"]} AND x.core <= eps AND y.core <= eps
      AND n.distance <= eps""",
        f"{p}reach": f"""
    SELECT review_id AS a, review_id AS b FROM {p}cores, {p}eps WHERE core <= eps
    UNION
    SELECT {p}reach.a, e.b FROM {p}reach
    JOIN (SELECT a, b FROM {p}links UNION SELECT b, a FROM {p}links) e ON {p}reach.b = e.a""",
        f"{p}parts": f"SELECT a AS review_id, min(b) AS part FROM {p}reach GROUP BY a",
        f"{p}sizes": f"""
    SELECT part, row_number() OVER (ORDER BY n DESC, part) - 1 AS topic
    FROM (SELECT part, count(*) AS n FROM {p}parts GROUP BY part) WHERE n >= {_C["min_cluster_size"]}""",
    }


def _density_needs(p: str, projected: str) -> dict[str, tuple[str, ...]]:
    return {
        f"{p}reduced": (projected,),
        f"{p}near": (f"{p}reduced",),
        f"{p}cores": (f"{p}near",),
        f"{p}eps": (f"{p}cores",),
        f"{p}links": (f"{p}near", f"{p}cores", f"{p}eps"),
        f"{p}reach": (f"{p}cores", f"{p}eps", f"{p}links"),
        f"{p}parts": (f"{p}reach",),
        f"{p}sizes": (f"{p}parts",),
    }


_LOW = "rating > 0 AND rating <= 2"


def _fit(p: str, rows: str, low: bool, trigger: float) -> dict[str, str]:
    """The parts of a whole analysis of ``rows``, named with the prefix ``p``."""
    return {
        f"{p}docs": f"""
    SELECT * REPLACE ({_cleaned("content_clean")} AS content_clean) FROM ({rows}) JOIN all_vectors USING (review_id)""",
        f"{p}forms": _forms(f"{p}docs"),
        f"{p}tok": _tokens(f"{p}docs", low, f"{p}forms"),
        f"{p}terms": _terms(f"{p}tok"),
        f"{p}seed_docs": f"""
    SELECT DISTINCT seed_id, review_id, embedding FROM seeds JOIN {p}tok USING (word) JOIN {p}docs USING (review_id)""",
        f"{p}seed_vec": _means(f"{p}seed_docs", "seed_id"),
        f"{p}guided": _guided(f"{p}docs", f"{p}seed_vec"),
        f"{p}projected": _projected(f"{p}guided", "review_id", "g"),
        **_density(p, f"{p}projected"),
        f"{p}first": f"""
    SELECT d.*, CAST(coalesce(topic, -1) AS INTEGER) AS topic
    FROM {p}docs d LEFT JOIN {p}parts USING (review_id) LEFT JOIN {p}sizes USING (part)""",
        f"{p}centroids": _means(f"(SELECT * FROM {p}first WHERE topic <> -1)", "topic"),
        f"{p}sims": _sims(f"{p}first", f"{p}centroids"),
        f"{p}moved": _moved(f"{p}first", f"{p}sims", trigger),
        f"{p}tf": _tf(f"{p}moved", f"{p}terms"),
        f"{p}weights": _weights(
            f"{p}tf",
            f"{p}moved",
            root=f"(SELECT avg(CASE WHEN old_topic = -1 THEN 1.0 ELSE 0.0 END) FROM {p}moved) <= {trigger}",
            seeded=True,
            min_df=1,
        ),
        f"{p}top": _top(f"{p}weights"),
        f"{p}names": _names(f"{p}moved", f"{p}top"),
        f"{p}labelled": f"""
    SELECT review_id, brand, topic, CASE WHEN topic = -1 THEN '{NOISE_LABEL}' ELSE topic_name END AS topic_name
    FROM {p}moved LEFT JOIN {p}names USING (topic)""",
    }


def _fit_needs(p: str, *rows: str) -> dict[str, tuple[str, ...]]:
    needs = {
        "forms": ("docs",),
        "tok": ("docs", "forms"),
        "terms": ("tok",),
        "seed_docs": ("tok", "docs"),
        "seed_vec": ("seed_docs",),
        "guided": ("docs", "seed_vec"),
        "first": ("docs", "parts", "sizes"),
        "centroids": ("first",),
        "sims": ("first", "centroids"),
        "moved": ("first", "sims"),
        "tf": ("moved", "terms"),
        "weights": ("tf", "moved"),
        "top": ("weights",),
        "names": ("moved", "top"),
        "labelled": ("moved", "names"),
    }
    found = {f"{p}{k}": tuple(f"{p}{n}" for n in v) for k, v in needs.items()}
    found |= {f"{p}docs": (*rows, "all_vectors"), f"{p}projected": (f"{p}guided", "signs")}
    found[f"{p}tok"] += ("dictionary",)
    found[f"{p}seed_docs"] += ("seeds",)
    return found | _density_needs(p, f"{p}projected")


def _fit_shared(p: str) -> set[str]:
    names = "docs forms tok terms guided projected reduced near cores links parts first moved tf weights top"
    return {f"{p}{n}" for n in names.split()}


def _examples(p: str) -> str:
    return f"""
    SELECT topic, CAST(rank AS INTEGER) AS rank, review_id, left(content_clean, 100) AS excerpt, keywords
    FROM (SELECT m.topic, m.review_id, content_clean,
                 row_number() OVER (PARTITION BY m.topic ORDER BY m.review_id) AS rank
          FROM {p}moved m JOIN {p}docs d ON d.review_id = m.review_id WHERE m.topic <> -1)
    LEFT JOIN (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords FROM {p}top GROUP BY topic) USING (topic)
    WHERE rank <= 3 AND topic IN (
      SELECT DISTINCT topic FROM {p}moved WHERE topic <> -1 ORDER BY topic LIMIT 10)"""


def _coverage(p: str, label: str) -> str:
    return f"""
    SELECT '{label}' AS label, count(*) FILTER (term IN (SELECT word FROM dictionary)) AS matched,
           count(*) AS total, coalesce(round(matched / nullif(total, 0) * 100, 6), 0) AS coverage
    FROM {p}top WHERE topic <> -1"""

PARTS = {
    "reviews": """
    SELECT doc_id AS review_id, source AS brand, CAST((doc_id // 20) % 6 AS INTEGER) AS rating,
           text AS content_clean FROM documents""",
    # Reviews without a stored vector have one made from their text.
    "positions": """
    SELECT row_number() OVER () - 1 AS review_id, source AS brand,
           CAST((doc_id // 20) % 6 AS INTEGER) AS rating, CAST(length(text) AS INTEGER) AS n_chars FROM documents""",
    "lacking": "SELECT * FROM reviews WHERE review_id NOT IN (SELECT vec_id FROM embeddings)",
    "lacking_words": """
    SELECT review_id, unnest(regexp_extract_all(lower(content_clean), '[\\p{L}]{2,}')) AS word FROM lacking""",
    "made": _hashed("lacking_words", "lacking", DIMS),
    "all_vectors": "SELECT vec_id AS review_id, embedding FROM embeddings UNION ALL SELECT * FROM made",
    "reviews_topic": """
    SELECT r.*, v.embedding, CASE WHEN coalesce(e.label, 9) = 9 THEN -1 ELSE e.label END AS topic
    FROM reviews r LEFT JOIN embeddings e ON r.review_id = e.vec_id JOIN all_vectors v USING (review_id)""",
    "low_reviews": f"SELECT * FROM reviews WHERE {_LOW}",
    "dictionary": f"SELECT * FROM (VALUES {_values((w, i) for i, w in enumerate(LEXICON.user_dict))}) t(word, pos)",
    "seeds": f"""
    SELECT *, CAST(word IN ({_list(LEXICON.user_dict)}) OR EXISTS (
      SELECT 1 FROM (SELECT s.word AS form UNION ALL SELECT k FROM (VALUES {_values(LEXICON.synonyms.items())}) y(k, v)
                     WHERE v = s.word) f
      WHERE regexp_full_match(form, '[\\p{{L}}]{{2,}}') AND form = lower(form)
        AND form NOT IN ({_list(LEXICON.stop_words)})
        AND (form <> s.word OR form NOT IN ({_list(LEXICON.synonyms)}))) AS INTEGER) AS reachable
    FROM (VALUES {_values((s, p, w) for s, words in enumerate(LEXICON.seeds) for p, w in enumerate(words))})
      s(seed_id, pos, word)""",
    "forms": _forms("reviews"),
    "tok": _tokens("reviews"),
    "low_tok": _tokens("low_reviews", low=True),
    "terms": _terms("tok"),
    "tf": _tf("reviews_topic"),
    "weights": _weights("tf"),
    "top": _top("weights"),
    "centroids": _means("(SELECT * FROM reviews_topic WHERE topic <> -1)", "topic"),
    "sims": _sims("reviews_topic", "centroids"),
    "moved": _moved("reviews_topic", "sims", reg.TRIGGER),
    "moved_tf": _tf("moved"),
    "moved_weights": _weights("moved_tf", "moved", root="false", seeded=True),
    "names": _names("reviews_topic", "top"),
    "labelled": f"""
    SELECT review_id, brand, rating, topic,
           CASE WHEN topic = -1 THEN '{NOISE_LABEL}' ELSE topic_name END AS topic_name
    FROM reviews_topic LEFT JOIN names USING (topic)""",
    "counts": _counts("labelled"),
    "shares": _shares("counts"),
    "signs": """
    SELECT c, d, CASE WHEN substr(md5('42:' || c || ':' || d), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS s
    FROM range(5) x(c), range(64) y(d)""",
    "projected": _projected("embeddings", "vec_id", "embedding"),
    **_density("", "projected"),
    # Fitted on the even ids, assigned to the odd ones.
    "e_projected": "SELECT * FROM projected WHERE review_id % 2 = 0",
    **_density("e_", "e_projected"),
    "o_near": f"""
    SELECT review_id, neighbor_id, distance,
           row_number() OVER (PARTITION BY review_id ORDER BY distance, neighbor_id) AS rank
    FROM (
      SELECT a.review_id, b.review_id AS neighbor_id, sqrt({_SQUARES}) AS distance
      FROM (SELECT * FROM reduced WHERE review_id % 2 = 1) a, e_reduced b)""",
    "o_links": f"""
    SELECT n.review_id, neighbor_id, distance, coalesce(topic, -1) AS topic,
           row_number() OVER (PARTITION BY n.review_id ORDER BY distance, neighbor_id) AS k
    FROM o_near n JOIN e_cores c ON c.review_id = neighbor_id
    LEFT JOIN e_parts p ON p.review_id = neighbor_id LEFT JOIN e_sizes USING (part), e_eps
    WHERE rank <= {_C["n_neighbors"]} AND core <= eps AND distance <= eps AND n.review_id IN (
      SELECT review_id FROM o_near, e_eps WHERE rank = {_C["min_samples"]} AND distance <= eps)""",
    # All merges of the neighbour graph, one by one.
    "h_cores": f"SELECT review_id, distance AS core FROM near WHERE rank = {_H['min_samples']}",
    "h_points": "SELECT review_id, row_number() OVER (ORDER BY review_id) AS p FROM reduced",
    "h_edges": f"""
    SELECT u.p AS pa, v.p AS pb, w, row_number() OVER (ORDER BY w, a, b) AS i,
           min(w) FILTER (w > 0) OVER () AS least
    FROM (
      SELECT least(n.review_id, neighbor_id) AS a, greatest(n.review_id, neighbor_id) AS b,
             min(greatest(x.core, y.core, distance)) AS w
      FROM near n JOIN h_cores x ON x.review_id = n.review_id JOIN h_cores y ON y.review_id = neighbor_id
      WHERE rank <= {_H["n_neighbors"]} GROUP BY ALL)
    JOIN h_points u ON u.review_id = a JOIN h_points v ON v.review_id = b""",
    "h_steps": f"""
    SELECT 0::BIGINT AS i, list(p ORDER BY p) AS label, list(1::BIGINT) AS size, list(NULL::BIGINT) AS own,
           list(0::DOUBLE) AS held, list(0::DOUBLE) AS below, list(NULL::BIGINT) AS place,
           []::STRUCT(cluster BIGINT, parent BIGINT, n BIGINT, birth DOUBLE, stability DOUBLE, below DOUBLE)[] AS ended
    FROM h_points
    UNION ALL
    SELECT i, list_transform(label, lambda l : CASE WHEN l = y THEN x ELSE l END),
           list_transform(size, lambda v, j : CASE WHEN j = x THEN v + m ELSE v END),
           list_transform(own, lambda v, j : CASE WHEN j = x THEN fresh ELSE v END),
           list_transform(held, lambda v, j : CASE
             WHEN j <> x OR fresh IS NULL THEN v
             WHEN c IS NOT NULL AND d IS NULL THEN v + m * rho
             WHEN d IS NOT NULL AND c IS NULL THEN held[y] + n * rho
             ELSE (n + m) * rho END),
           list_transform(below, lambda v, j : CASE
             WHEN j <> x OR fresh IS NULL OR d IS NULL THEN v
             WHEN c IS NULL THEN below[y]
             ELSE greatest(held[x] - n * rho, below[x]) + greatest(held[y] - m * rho, below[y]) END),
           list_transform(place, lambda v, j : CASE WHEN v IS NULL AND label[j] IN (x, y) THEN fresh ELSE v END),
           CASE WHEN x <> y AND c IS NOT NULL AND d IS NOT NULL THEN [
             {{'cluster': c, 'parent': i, 'n': n, 'birth': rho, 'stability': held[x] - n * rho, 'below': below[x]}},
             {{'cluster': d, 'parent': i, 'n': m, 'birth': rho, 'stability': held[y] - m * rho, 'below': below[y]}}]
           ELSE [] END
    FROM (
      SELECT *, CASE WHEN x = y THEN c WHEN c IS NOT NULL AND d IS NOT NULL THEN i
                     WHEN c IS NOT NULL THEN c WHEN d IS NOT NULL THEN d
                     WHEN n + m >= {_H["min_cluster_size"]} THEN i END AS fresh
      FROM (
        SELECT e.i, label, size, own, held, below, place, label[pa] AS x, label[pb] AS y, 1 / greatest(w, least) AS rho,
               size[label[pa]] AS n, CASE WHEN label[pa] = label[pb] THEN 0 ELSE size[label[pb]] END AS m,
               own[label[pa]] AS c, CASE WHEN label[pa] = label[pb] THEN NULL ELSE own[label[pb]] END AS d
        FROM h_steps s JOIN h_edges e ON e.i = s.i + 1))""",
    "h_last": "SELECT * FROM h_steps ORDER BY i DESC LIMIT 1",
    "h_tops": """
    SELECT DISTINCT own[x] AS cluster, NULL::BIGINT AS parent, size[x] AS n, 0::DOUBLE AS birth,
           held[x] AS stability, below[x] AS below
    FROM (SELECT *, unnest(label) AS x FROM h_last) WHERE own[x] IS NOT NULL""",
    "h_clusters": """
    SELECT *, stability >= below AND (parent IS NOT NULL OR (SELECT count(*) FROM h_tops) > 1) AS pick
    FROM (SELECT unnest(ended, recursive := true) FROM h_steps UNION ALL SELECT * FROM h_tops)""",
    "h_chains": """
    SELECT cluster, parent AS up, CASE WHEN pick THEN cluster END AS chosen FROM h_clusters
    UNION ALL
    SELECT h.cluster, c.parent, CASE WHEN c.pick THEN c.cluster ELSE chosen END
    FROM h_chains h JOIN h_clusters c ON c.cluster = h.up""",
    "h_groups": """
    SELECT review_id, chosen FROM (SELECT unnest(place) AS cluster, generate_subscripts(place, 1) AS p FROM h_last)
    JOIN h_points USING (p) LEFT JOIN (SELECT * FROM h_chains WHERE up IS NULL) USING (cluster)""",
    "h_sizes": """
    SELECT chosen, row_number() OVER (ORDER BY count(*) DESC, min(review_id)) - 1 AS topic
    FROM h_groups WHERE chosen IS NOT NULL GROUP BY chosen""",
    "seed_docs": """
    SELECT DISTINCT seed_id, review_id, embedding FROM seeds JOIN tok USING (word)
    JOIN reviews_topic USING (review_id)""",
    "seed_vec": _means("seed_docs", "seed_id"),
    # The whole fit, on the rated reviews.
    "f_docs": """
    SELECT review_id, brand, embedding FROM reviews JOIN all_vectors USING (review_id) WHERE rating > 0""",
    "f_seed_docs": """
    SELECT DISTINCT seed_id, review_id, embedding FROM seeds JOIN tok USING (word)
    JOIN f_docs USING (review_id)""",
    "f_seed_vec": _means("f_seed_docs", "seed_id"),
    "f_guided": _guided("f_docs", "f_seed_vec"),
    "f_projected": _projected("f_guided", "review_id", "g"),
    **_density("f_", "f_projected"),
    "f_first": """
    SELECT d.*, CAST(coalesce(topic, -1) AS INTEGER) AS topic
    FROM f_docs d LEFT JOIN f_parts USING (review_id) LEFT JOIN f_sizes USING (part)""",
    "f_centroids": _means("(SELECT * FROM f_first WHERE topic <> -1)", "topic"),
    "f_sims": _sims("f_first", "f_centroids"),
    "f_moved": _moved("f_first", "f_sims", 0.4),
    "f_tf": _tf("f_moved"),
    "f_weights": _weights(
        "f_tf",
        "f_moved",
        root="(SELECT avg(CASE WHEN old_topic = -1 THEN 1.0 ELSE 0.0 END) FROM f_moved) <= 0.4",
        seeded=True,
        min_df=1,
    ),
    "f_top": _top("f_weights"),
    "f_names": _names("f_moved", "f_top"),
    "f_labelled": f"""
    SELECT review_id, brand, topic,
           CASE WHEN topic = -1 THEN '{NOISE_LABEL}' ELSE topic_name END AS topic_name
    FROM f_moved LEFT JOIN f_names USING (topic)""",
    "f_counts": _counts("f_labelled"),
    "f_shares": _shares("f_counts"),
    # Both analyses from their rows on, that of all reviews from a sample and from all of them.
    **_fit("fw_", "SELECT * FROM reviews WHERE rating > 0", False, 0.4),
    **_fit("fa_", f"""
      SELECT * EXCLUDE (k) FROM (
        SELECT *, row_number() OVER (PARTITION BY brand ORDER BY md5('42:' || review_id), review_id) AS k
        FROM reviews WHERE rating > 0 AND brand IS NOT NULL) WHERE k <= {reg.SAMPLE_CAP}""", False, 0.4),
    **_fit("fl_", f"""SELECT * FROM low_reviews WHERE {_cleaned("content_clean")} <> ''""", True, 0.3),
}

NEEDS = {
    "lacking": ("reviews",),
    "lacking_words": ("lacking",),
    "made": ("lacking_words", "lacking"),
    "all_vectors": ("made", "reviews"),
    "reviews_topic": ("reviews", "all_vectors"),
    "low_reviews": ("reviews",),
    "forms": ("reviews",),
    "tok": ("reviews", "dictionary", "forms"),
    "low_tok": ("low_reviews", "dictionary", "forms"),
    "terms": ("tok",),
    "tf": ("terms", "reviews_topic"),
    "weights": ("tf", "reviews_topic"),
    "top": ("weights",),
    "centroids": ("reviews_topic",),
    "sims": ("reviews_topic", "centroids"),
    "moved": ("reviews_topic", "sims"),
    "moved_tf": ("moved", "terms"),
    "moved_weights": ("moved_tf", "moved"),
    "names": ("reviews_topic", "top"),
    "labelled": ("reviews_topic", "names"),
    "counts": ("labelled",),
    "shares": ("counts",),
    "projected": ("signs",),
    **_density_needs("", "projected"),
    "e_projected": ("projected",),
    **_density_needs("e_", "e_projected"),
    "h_cores": ("near",),
    "h_points": ("reduced",),
    "h_edges": ("near", "h_cores", "h_points"),
    "h_steps": ("h_points", "h_edges"),
    "h_last": ("h_steps",),
    "h_tops": ("h_last",),
    "h_clusters": ("h_steps", "h_tops"),
    "h_chains": ("h_clusters",),
    "h_groups": ("h_last", "h_points", "h_chains"),
    "h_sizes": ("h_groups",),
    "o_near": ("reduced", "e_reduced"),
    "o_links": ("o_near", "e_cores", "e_parts", "e_sizes", "e_eps"),
    "seed_docs": ("seeds", "tok", "reviews_topic"),
    "seed_vec": ("seed_docs",),
    "f_docs": ("reviews", "all_vectors"),
    "f_seed_docs": ("seeds", "tok", "f_docs"),
    "f_seed_vec": ("f_seed_docs",),
    "f_guided": ("f_docs", "f_seed_vec"),
    "f_projected": ("f_guided", "signs"),
    **_density_needs("f_", "f_projected"),
    "f_first": ("f_docs", "f_parts", "f_sizes"),
    "f_centroids": ("f_first",),
    "f_sims": ("f_first", "f_centroids"),
    "f_moved": ("f_first", "f_sims"),
    "f_tf": ("f_moved", "terms"),
    "f_weights": ("f_tf", "f_moved"),
    "f_top": ("f_weights",),
    "f_names": ("f_moved", "f_top"),
    "f_labelled": ("f_moved", "f_names"),
    "f_counts": ("f_labelled",),
    "f_shares": ("f_counts",),
    **_fit_needs("fa_", "reviews"),
    **_fit_needs("fw_", "reviews"),
    **_fit_needs("fl_", "low_reviews"),
}
# Parts that several others read are worked out once.
SHARED = {
    *("tok", "terms", "forms", "tf", "weights", "projected", "reduced", "near", "cores", "links"),
    *("f_guided", "f_projected", "f_reduced", "f_near", "f_cores", "f_links", "f_parts", "f_first"),
    *("f_moved", "f_tf", "f_weights", "all_vectors", "reviews"),
    *_fit_shared("fa_"),
    *_fit_shared("fw_"),
    *_fit_shared("fl_"),
    *("h_edges", "h_steps", "h_last", "h_clusters", "h_groups"),
    *("e_reduced", "e_near", "e_cores", "e_links", "e_parts", "o_near"),
}


def _with(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for need in needs:
        add(need)
    parts = ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({PARTS[n]})" for n in order
    )
    return f"WITH RECURSIVE {parts}\n{body}"


def oracle_queries() -> dict[str, str]:
    token_rows = (
        "SELECT review_id, coalesce(string_agg(word, ' ' ORDER BY ord), '') AS tokens,"
        " CAST(count(word) AS INTEGER) AS n_tokens FROM {docs} LEFT JOIN {tok} USING (review_id)"
        " GROUP BY review_id"
    )
    rounded = "SELECT topic, term, n, round(weight, 6) AS weight FROM "
    ranked = "SELECT topic, rank, term, round(weight, 6) AS weight FROM "
    return {
        "top_topics_per_brand": _with(_top_five("shares"), "shares"),
        "brand_topic_counts": _with("SELECT * FROM counts", "counts"),
        "brand_topic_share": _with("SELECT * FROM shares", "shares"),
        "brand_topic_share_by_scope": _with(
            f"""SELECT *, round_even(count / sum(count) OVER (PARTITION BY scope, brand) * 100 * 10, 0) / 10 AS ratio
            FROM (
              SELECT scope, brand, topic_name, count(*) AS count FROM (
                SELECT 'all' AS scope, * FROM labelled WHERE rating > 0
                UNION ALL SELECT 'low', * FROM labelled WHERE {_LOW})
              WHERE topic <> -1 GROUP BY scope, brand, topic_name)""",
            "labelled",
        ),
        "rated_reviews": _with("SELECT * FROM reviews WHERE rating > 0", "reviews"),
        "low_rated_reviews": _with(f"SELECT * FROM reviews WHERE {_LOW}", "reviews"),
        "valid_reviews": _with(
            f"""SELECT review_id, brand, {_cleaned("content_clean")} AS content_clean,
              CAST(len(embedding) AS INTEGER) AS dims
            FROM reviews JOIN all_vectors USING (review_id)
            WHERE {_LOW} AND {_cleaned("content_clean")} <> ''""",
            "all_vectors",
        ),
        "sample_per_brand": _with(
            f"""SELECT review_id, brand, rating FROM (
              SELECT *, row_number() OVER (PARTITION BY brand ORDER BY md5('42:' || review_id), review_id) AS k
              FROM reviews WHERE rating > 0 AND brand IS NOT NULL) WHERE k <= {reg.SAMPLE_CAP}""",
            "reviews",
        ),
        "clean_review_text": _with(
            f"SELECT review_id, {_cleaned('content_clean')} AS content_clean FROM reviews", "reviews"
        ),
        "brand_counts": _with(
            "SELECT brand, count(*) AS count FROM reviews WHERE rating > 0 AND brand IS NOT NULL GROUP BY brand",
            "reviews",
        ),
        "brands_first_seen": _with(
            "SELECT brand, min(review_id) AS first_id FROM reviews WHERE rating > 0 GROUP BY brand",
            "reviews",
        ),
        "dataset_summary": _with(
            f"""SELECT (SELECT count(*) FROM reviews) AS n_reviews,
              (SELECT count(*) FROM reviews WHERE rating > 0) AS n_rated,
              (SELECT CAST(sum(least(n, {reg.SAMPLE_CAP})) AS BIGINT) FROM
                (SELECT count(*) AS n FROM reviews WHERE rating > 0 GROUP BY brand)) AS n_sample,
              (SELECT count(*) FROM low_reviews) AS n_low,
              (SELECT count(*) FROM low_reviews WHERE trim(content_clean, {_text(_SPACE)}) <> '') AS n_low_valid""",
            "low_reviews",
        ),
        **{
            name: _with(
                "SELECT review_id, word FROM reviews JOIN dictionary ON contains(content_clean, word)",
                "reviews",
                "dictionary",
            )
            for name in ("dictionary_matches", "dictionary_matches_table")
        },
        "normalize_tokens": _with(
            f"""SELECT review_id, coalesce(string_agg({_SYNONYM}, ' ' ORDER BY pos), '') AS tokens,
              CAST(count(word) AS INTEGER) AS n_tokens
            FROM reviews LEFT JOIN (
              SELECT review_id, unnest(forms) AS word, generate_subscripts(forms, 1) AS pos FROM (
                SELECT review_id, regexp_extract_all(lower(content_clean), '[\\p{{L}}]{{2,}}') AS forms
                FROM reviews)) USING (review_id) GROUP BY review_id""",
            "reviews",
        ),
        "tokenize_reviews": _with(token_rows.format(docs="reviews", tok="tok"), "tok"),
        "tokenize_low_reviews": _with(token_rows.format(docs="low_reviews", tok="low_tok"), "low_tok"),
        "review_ngrams": _with(
            """SELECT review_id, coalesce(string_agg(term, '|' ORDER BY part, ord), '') AS terms,
              CAST(count(term) AS INTEGER) AS n_terms
            FROM reviews LEFT JOIN terms USING (review_id) GROUP BY review_id""",
            "terms",
        ),
        "seed_topic_summary": _with(
            """SELECT s.seed_id, count(*) AS n_words,
              string_agg(s.word, ', ' ORDER BY pos) FILTER (pos < 3) AS first_words,
              CAST(sum(reachable) AS BIGINT) AS n_reachable, count(hits) AS n_found,
              CAST(coalesce(sum(hits), 0) AS BIGINT) AS n_hits,
              (SELECT count(DISTINCT review_id) FROM tok JOIN seeds x USING (word)
               WHERE x.seed_id = s.seed_id) AS n_reviews
            FROM seeds s LEFT JOIN (SELECT word, count(*) AS hits FROM tok GROUP BY word) h
              ON s.word = h.word GROUP BY s.seed_id""",
            "seeds",
            "tok",
        ),
        "topic_term_frequency": _with("SELECT * FROM tf", "tf"),
        "class_tfidf": _with(rounded + "weights", "weights"),
        "class_tfidf_binary": _with(f"{rounded} ({_weights('tf', binary=True)})", "tf"),
        "class_tfidf_seeded": _with(f"{rounded} ({_weights('tf', seeded=True)})", "tf"),
        "topic_keywords": _with(ranked + "top", "top"),
        "refresh_topic_keywords": _with(f"{ranked} ({_top('moved_weights')})", "moved_weights"),
        "topic_names": _with("SELECT * FROM names", "names"),
        "outlier_ratio": _with(
            """SELECT count(*) AS n_reviews, count(*) FILTER (topic = -1) AS n_outliers,
              round(count(*) FILTER (topic = -1) / count(*), 6) AS outlier_ratio,
              count(DISTINCT topic) FILTER (topic <> -1) AS n_topics FROM reviews_topic""",
            "reviews_topic",
        ),
        "topic_info": _with(
            """SELECT topic, count(*) AS n, any_value(topic_name) AS topic_name FROM labelled
            GROUP BY topic ORDER BY topic LIMIT 16""",
            "labelled",
        ),
        "dictionary_coverage": _with(
            """SELECT 'all' AS label, count(*) FILTER (term IN (SELECT word FROM dictionary)) AS matched,
              count(*) AS total, round(matched / total * 100, 6) AS coverage
            FROM top WHERE topic <> -1""",
            "dictionary",
            "top",
        ),
        "label_reviews": _with("SELECT * FROM labelled", "labelled"),
        "topic_examples": _with(
            """SELECT topic, CAST(rank AS INTEGER) AS rank, review_id, left(content_clean, 100) AS excerpt, keywords
            FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY review_id) AS rank
                  FROM reviews_topic WHERE topic <> -1)
            LEFT JOIN (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords FROM top GROUP BY topic)
              USING (topic)
            WHERE rank <= 3 AND topic IN (
              SELECT DISTINCT topic FROM reviews_topic WHERE topic <> -1 ORDER BY topic LIMIT 10)""",
            "top",
        ),
        "knn": _with(
            f"""SELECT review_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance
            FROM near WHERE rank <= {reg.NEAR}""",
            "near",
        ),
        "core_distance": _with(
            f"""SELECT review_id, round(distance, 6) AS core_distance FROM near
            WHERE rank = {reg.CORE_SAMPLES}""",
            "near",
        ),
        "topic_membership": _with(
            """SELECT review_id, topic, coalesce(round(sim / nullif(total, 0), 4), 0) AS prob
            FROM (SELECT *, sum(sim) OVER (PARTITION BY review_id) AS total FROM sims)""",
            "sims",
        ),
        "reassign_outliers": _with("SELECT * FROM moved", "moved"),
        "seed_label_topics": _with(
            """SELECT topic, seed_id, round(sim, 4) AS similarity FROM (
              SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, seed_id) AS k FROM (
                SELECT c.topic, s.seed_id, list_cosine_similarity(c.vec, s.vec) AS sim
                FROM centroids c, seed_vec s)) WHERE k = 1""",
            "centroids",
            "seed_vec",
        ),
        "seed_guided_vectors": _with(
            f"""SELECT review_id, seed_id, {", ".join(f"round(g[{i + 1}], 4) AS g{i}" for i in range(4))},
              round(sqrt(list_dot_product(g, g)), 4) AS length
            FROM ({_guided("reviews_topic", "seed_vec")})""",
            "reviews_topic",
            "seed_vec",
        ),
        "reduce_random_projection": _with("SELECT * FROM reduced", "reduced"),
        "density_topics": _with(
            """SELECT vec_id AS review_id, CAST(coalesce(topic, -1) AS INTEGER) AS topic
            FROM embeddings LEFT JOIN parts ON vec_id = review_id LEFT JOIN sizes USING (part)""",
            "sizes",
        ),
        "hierarchy_topics": _with(
            """SELECT review_id, CAST(coalesce(topic, -1) AS INTEGER) AS topic
            FROM h_groups LEFT JOIN h_sizes USING (chosen)""",
            "h_sizes",
        ),
        "hierarchy_clusters": _with(
            """SELECT n, round(birth, 4) AS birth, round(stability, 4) AS stability, coalesce(chosen = cluster, false) AS selected
            FROM h_clusters JOIN (SELECT cluster, chosen FROM h_chains WHERE up IS NULL) USING (cluster)""",
            "h_chains",
        ),
        "assign_new_reviews": _with(
            """SELECT review_id, CAST(coalesce(l.topic, -1) AS INTEGER) AS topic, neighbor_id AS nearest_id,
              round(l.distance, 6) AS distance
            FROM (SELECT review_id FROM reduced WHERE review_id % 2 = 1)
            LEFT JOIN (SELECT * FROM o_links WHERE k = 1) l USING (review_id)""",
            "reduced",
            "o_links",
        ),
        "knn_new_reviews": _with(
            f"""SELECT review_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance
            FROM o_near WHERE rank <= {reg.NEAR}""",
            "o_near",
        ),
        "distance_quantiles": _with(
            f"""SELECT q, (
              SELECT min(distance) FROM (
                SELECT distance, count(*) OVER (ORDER BY distance RANGE UNBOUNDED PRECEDING) AS upto
                FROM near WHERE rank <= {reg.NEAR})
              WHERE upto >= q * (SELECT count(*) FROM near WHERE rank <= {reg.NEAR})) AS distance
            FROM (SELECT unnest([{", ".join(map(str, reg.QUANTILES))}]::DOUBLE[]) AS q)""",
            "near",
        ),
        "hash_embed": _with(
            f"""SELECT review_id, CAST(len(embedding) AS INTEGER) AS dims,
              CAST(len(list_filter(embedding, lambda x: x <> 0)) AS INTEGER) AS nonzero,
              round(CAST(list_max(embedding) AS DOUBLE), 4) AS peak
            FROM ({_hashed("tok", "reviews", FEATURES)})""",
            "tok",
            "reviews",
        ),
        "fit_topics": _with(
            "SELECT topic, count(*) AS n, any_value(topic_name) AS topic_name FROM f_labelled GROUP BY topic",
            "f_labelled",
        ),
        **{
            f"fit_topics_{scope}": _with(
                f"SELECT topic, count(*) AS n, any_value(topic_name) AS topic_name FROM {p}labelled GROUP BY topic",
                f"{p}labelled",
            )
            for scope, p in (("all", "fa_"), ("low", "fl_"))
        },
        "coverage_by_scope": _with(
            f"{_coverage('fw_', 'all')} UNION ALL {_coverage('fl_', 'low')}", "dictionary", "fw_top", "fl_top"
        ),
        "examples_by_scope": _with(
            f"SELECT 'all' AS scope, * FROM ({_examples('fw_')}) UNION ALL SELECT 'low', * FROM ({_examples('fl_')})",
            "fw_top",
            "fl_top",
        ),
        "fitted_brand_topics": _with(_top_five("f_shares"), "f_shares"),
        "embedding_cache_misses": _with(
            """SELECT DISTINCT sha256(content_clean) AS text_hash, CAST(length(content_clean) AS INTEGER) AS n_chars
            FROM reviews WHERE sha256(content_clean) NOT IN (
              SELECT sha256(content_clean) FROM reviews JOIN embeddings ON review_id = vec_id)""",
            "reviews",
        ),
        **{
            name: _with(body, "positions")
            for name, body in {
                "reviews_by_position": "SELECT * FROM positions",
                "renumbered_low_reviews": f"""SELECT * EXCLUDE (review_id), review_id AS position,
                  row_number() OVER (ORDER BY review_id) - 1 AS review_id FROM positions WHERE {_LOW}""",
                "brands_first_position": """SELECT brand, min(review_id) AS first_id FROM positions
                  WHERE rating > 0 GROUP BY brand""",
            }.items()
        },
        "run_report": _with(
            f"""SELECT CAST(step AS INTEGER) AS step, stage, figure, CAST(value AS DOUBLE) AS value FROM (
              SELECT 0 AS step, 'rated' AS stage, 'rows' AS figure, count(*) AS value FROM reviews WHERE rating > 0
              UNION ALL SELECT 0, 'rated', 'text_bytes', sum(strlen(content_clean)) FROM reviews WHERE rating > 0
              UNION ALL SELECT 1, 'sample', 'rows', sum(least(n, {reg.SAMPLE_CAP})) FROM (
                SELECT count(*) AS n FROM reviews WHERE rating > 0 AND brand IS NOT NULL GROUP BY brand)
              UNION ALL SELECT 2, 'low', 'rows', count(*) FROM low_reviews
              UNION ALL SELECT 2, 'low', 'blank', count(*) FROM low_reviews WHERE {_cleaned("content_clean")} = ''
              UNION ALL SELECT 3, 'low valid', 'rows', count(*) FROM low_reviews WHERE {_cleaned("content_clean")} <> ''
              UNION ALL SELECT 4, 'topics', 'rows', count(*) FROM reviews_topic
              UNION ALL SELECT 4, 'topics', 'outliers', count(*) FROM reviews_topic WHERE topic = -1
              UNION ALL SELECT 4, 'topics', 'last_topic', max(topic) FROM reviews_topic
              UNION ALL SELECT 5, 'after reassignment', 'rows', count(*) FROM moved
              UNION ALL SELECT 5, 'after reassignment', 'outliers', count(*) FROM moved WHERE topic = -1
              UNION ALL SELECT 5, 'after reassignment', 'moved', count(*) FROM moved WHERE topic <> old_topic)""",
            "low_reviews",
            "reviews_topic",
            "moved",
        ),
        "embedding_cache_fill": _with(
            """SELECT review_id, CASE WHEN content_clean IN (
                SELECT content_clean FROM reviews WHERE review_id % 2 = 0) THEN 'a' ELSE 'b' END AS batch,
              CAST(length(content_clean) AS FLOAT) AS v0,
              CAST(length(content_clean) - length(replace(content_clean, 'e', '')) AS FLOAT) AS v1,
              (SELECT count(DISTINCT content_clean) FROM reviews) AS n_stored FROM reviews""",
            "reviews",
        ),
        "model_round_trip": _with(
            "SELECT topic, rank, term, round(weight, 6) AS weight, topic_name FROM top LEFT JOIN names USING (topic)",
            "top",
            "names",
        ),
        "export_csv": _with(
            "SELECT review_id, brand, rating, content_clean, topic FROM reviews_topic", "reviews_topic"
        ),
    }
