"""Named steps of the checking SQL, joined into one statement on demand."""

from __future__ import annotations

# step name -> (steps it reads, body)
STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "actions": (
        (),
        """SELECT user_id AS uid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS aid,
                  event_type AS action, strftime(ts, '%Y%m%d') AS action_date
           FROM events""",
    ),
    "weighted": (
        ("actions",),
        """SELECT *, DATE '2024-01-31' - CAST(strptime(action_date, '%Y%m%d') AS DATE) AS days,
                  CAST(CASE action WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.15
                       WHEN 'signup' THEN 0.2 WHEN 'purchase' THEN 0.3 ELSE 0 END AS FLOAT) AS weight
           FROM actions""",
    ),
    "timed": (
        ("weighted",),
        """SELECT *, CAST(1 / (1 + exp(1 - (CASE WHEN days > 14 THEN 1 ELSE 14 - days END - 7)
                                        * CAST(0.8 AS DOUBLE))) AS FLOAT) AS freshness
           FROM weighted""",
    ),
    "rated": (("timed",), "SELECT *, weight * freshness AS rating FROM timed"),
    "ratings": (
        ("rated",),
        "SELECT uid, aid, CAST(sum(rating) AS DOUBLE) AS rating FROM rated GROUP BY uid, aid",
    ),
    "train": (("ratings",), "SELECT * FROM ratings WHERE (uid * 31 + aid * 17) % 5 <> 0"),
    "holdout": (("ratings",), "SELECT * FROM ratings WHERE (uid * 31 + aid * 17) % 5 = 0"),
    "norms": (
        ("train",),
        "SELECT aid, sqrt(sum(rating * rating)) AS norm FROM train WHERE rating <> 0 GROUP BY aid",
    ),
    "sim": (
        ("train", "norms"),
        """SELECT p.aid, p.sim_aid, p.dot / (x.norm * y.norm) AS sim
           FROM (SELECT a.aid, b.aid AS sim_aid, sum(a.rating * b.rating) AS dot
                 FROM train a JOIN train b ON a.uid = b.uid AND a.aid < b.aid
                 WHERE a.rating <> 0 AND b.rating <> 0 GROUP BY a.aid, b.aid) p
           JOIN norms x ON p.aid = x.aid JOIN norms y ON p.sim_aid = y.aid""",
    ),
    "sym": (
        ("sim",),
        "SELECT aid, sim_aid, sim FROM sim UNION ALL SELECT sim_aid, aid, sim FROM sim",
    ),
    "rsp": (
        ("train", "sym"),
        """SELECT t.uid, t.aid, t.rating, s.sim_aid, s.sim, t.rating * s.sim AS rsp
           FROM train t JOIN sym s ON t.aid = s.aid""",
    ),
    "scores": (
        ("rsp",),
        """SELECT uid, sim_aid, sum(rsp) / sum(sim) AS pred_rating
           FROM rsp GROUP BY uid, sim_aid""",
    ),
    "unseen": (
        ("scores", "train"),
        """SELECT s.* FROM scores s WHERE NOT EXISTS
           (SELECT 1 FROM train t WHERE t.uid = s.uid AND t.aid = s.sim_aid)""",
    ),
    "topk": (
        ("unseen",),
        """SELECT uid, sim_aid, pred_rating, rank FROM
           (SELECT *, row_number() OVER (PARTITION BY uid
                      ORDER BY round(pred_rating, 6) DESC, sim_aid) AS rank FROM unseen)
           WHERE rank <= 25""",
    ),
    "predicted": (
        ("holdout", "scores"),
        """SELECT h.uid, h.aid, h.rating, s.pred_rating FROM holdout h
           JOIN scores s ON h.uid = s.uid AND h.aid = s.sim_aid""",
    ),
    "order_ratings": (
        (),
        """SELECT o_custkey AS uid, l_partkey AS aid, sum(l_quantity) AS rating
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey""",
    ),
    "order_norms": (
        ("order_ratings",),
        "SELECT aid, sqrt(sum(rating * rating)::DOUBLE) AS norm FROM order_ratings GROUP BY aid",
    ),
    "order_sim": (
        ("order_ratings", "order_norms"),
        """SELECT p.aid, p.sim_aid, p.dot / (x.norm * y.norm) AS sim
           FROM (SELECT a.aid, b.aid AS sim_aid, sum(a.rating * b.rating)::DOUBLE AS dot
                 FROM order_ratings a JOIN order_ratings b ON a.uid = b.uid AND a.aid <> b.aid
                 GROUP BY a.aid, b.aid) p
           JOIN order_norms x ON p.aid = x.aid JOIN order_norms y ON p.sim_aid = y.aid""",
    ),
    "order_scores": (
        ("order_ratings", "order_sim"),
        """SELECT t.uid, s.sim_aid, sum(t.rating::DOUBLE * s.sim) / sum(s.sim) AS pred_rating
           FROM order_ratings t JOIN order_sim s ON t.aid = s.aid GROUP BY t.uid, s.sim_aid""",
    ),
    "articles": (
        (),
        """SELECT doc_id AS article_id, CAST(n_chars AS INTEGER) AS article_num,
                  CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS img_num,
                  source AS type_name, CAST(doc_id % 30 AS INTEGER) AS pub_gap
           FROM documents""",
    ),
    "profiles": (
        (),
        """SELECT c_custkey AS uid, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
                  CAST(floor(abs(c_acctbal) / 100) AS INTEGER) AS age,
                  lower(n_name) || '.com' AS email_suffix
           FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "terms": (
        (),
        """SELECT vec_id % 100 AS article_id, 't' || vec_id AS top_term,
                  CAST(embedding AS DOUBLE[]) AS vector
           FROM embeddings WHERE embedding IS NOT NULL""",
    ),
    "samples": (
        ("actions",),
        """SELECT uid, aid, CAST(max(CASE WHEN action IN ('click', 'purchase') THEN 1 ELSE 0 END)
                                 AS INTEGER) AS label
           FROM actions GROUP BY uid, aid""",
    ),
    "gender_index": (
        ("profiles",),
        """SELECT gender AS value, row_number() OVER (ORDER BY count(*) DESC, gender) - 1 AS idx
           FROM profiles GROUP BY gender""",
    ),
    "email_index": (
        ("profiles",),
        """SELECT email_suffix AS value,
                  row_number() OVER (ORDER BY count(*) DESC, email_suffix) - 1 AS idx
           FROM profiles GROUP BY email_suffix""",
    ),
    "type_index": (
        ("articles",),
        """SELECT type_name AS value,
                  row_number() OVER (ORDER BY count(*) DESC, type_name) - 1 AS idx
           FROM articles GROUP BY type_name""",
    ),
    "aged": (
        ("profiles",),
        """SELECT *, CASE WHEN age < 15 THEN 0 WHEN age < 25 THEN 1 WHEN age < 35 THEN 2
                          WHEN age < 50 THEN 3 WHEN age < 60 THEN 4 ELSE 5 END AS age_group
           FROM profiles""",
    ),
    "user_sizes": (
        ("aged", "gender_index", "email_index"),
        """SELECT min(age_group) AS low, max(age_group) AS high,
                  (SELECT count(*) FROM gender_index) AS genders,
                  (SELECT count(*) FROM email_index) AS emails
           FROM aged""",
    ),
    "user_vectors": (
        ("aged", "gender_index", "email_index", "user_sizes"),
        """SELECT a.uid, list_concat(list_concat(
                    [CASE WHEN i = g.idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                     FOR i IN range(0, z.genders - 1)],
                    [CASE WHEN i = e.idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                     FOR i IN range(0, z.emails - 1)]),
                    [CASE WHEN z.high = z.low THEN 0.5::DOUBLE
                          ELSE (a.age_group - z.low)::DOUBLE / (z.high - z.low) END]) AS features
           FROM aged a JOIN gender_index g ON a.gender = g.value
           JOIN email_index e ON a.email_suffix = e.value CROSS JOIN user_sizes z""",
    ),
    "article_sizes": (
        ("articles", "type_index"),
        """SELECT min(article_num) AS n0, max(article_num) AS n1, min(img_num) AS i0,
                  max(img_num) AS i1, min(pub_gap) AS p0, max(pub_gap) AS p1,
                  (SELECT count(*) FROM type_index) AS types
           FROM articles""",
    ),
    "scaled": (
        ("articles", "article_sizes"),
        """SELECT a.article_id, a.type_name,
                  CASE WHEN n1 = n0 THEN 0.5 ELSE (article_num - n0)::DOUBLE / (n1 - n0) END AS sn,
                  CASE WHEN i1 = i0 THEN 0.5 ELSE (img_num - i0)::DOUBLE / (i1 - i0) END AS si,
                  CASE WHEN p1 = p0 THEN 0.5 ELSE (pub_gap - p0)::DOUBLE / (p1 - p0) END AS sp
           FROM articles a CROSS JOIN article_sizes""",
    ),
    "article_vectors": (
        ("scaled", "type_index", "article_sizes"),
        """SELECT s.article_id, list_concat([sn, si, sp],
                    [CASE WHEN i = t.idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                     FOR i IN range(0, z.types - 1)]) AS features
           FROM scaled s JOIN type_index t ON s.type_name = t.value CROSS JOIN article_sizes z""",
    ),
    "embedded": (
        ("terms",),
        """SELECT article_id, list(mean ORDER BY slot) AS article_vector FROM
           (SELECT article_id, slot, avg(vector[slot]) AS mean
            FROM terms CROSS JOIN range(1, 65) slots(slot) GROUP BY article_id, slot)
           GROUP BY article_id""",
    ),
    "candidates": (
        ("topk", "article_vectors", "embedded"),
        """SELECT t.uid, t.sim_aid, t.pred_rating, v.features, e.article_vector
           FROM topk t JOIN article_vectors v ON t.sim_aid = v.article_id
           JOIN embedded e ON t.sim_aid = e.article_id""",
    ),
    "assembled": (
        ("samples", "user_vectors", "article_vectors", "embedded"),
        """SELECT s.uid, s.aid, s.label, u.features AS user_features,
                  v.features AS article_features, e.article_vector AS article_embedding
           FROM samples s JOIN user_vectors u ON s.uid = u.uid
           JOIN article_vectors v ON s.aid = v.article_id
           JOIN embedded e ON s.aid = e.article_id""",
    ),
    "linear": (
        (),
        """SELECT vec_id, label % 2 AS label, 0.25::DOUBLE
                  + list_sum([embedding[i]::DOUBLE * ((i * 37 % 41 - 20)::DOUBLE / 10)
                              FOR i IN range(1, 65)]) AS z
           FROM embeddings""",
    ),
    "scored": (
        ("linear",),
        """SELECT *, 1 / (1 + exp(-z)) AS p1, CASE WHEN 1 / (1 + exp(-z)) > 0.5 THEN 1 ELSE 0 END
                  AS prediction FROM linear""",
    ),
}


def text(vector: str, digits: int = 6) -> str:
    """SQL for a list as ``[a,b,c]`` with fixed decimals."""
    return f"('[' || array_to_string([printf('%.{digits}f', x) FOR x IN {vector}], ',') || ']')"


def millionths(vector: str) -> str:
    """SQL for a list as comma-separated whole millionths."""
    return f"array_to_string([CAST(round(x * 1e6) AS BIGINT) FOR x IN {vector}], ',')"


def using(*names: str, select: str) -> str:
    """A statement whose WITH list holds ``names`` and all they read, in order."""
    wanted: dict[str, None] = {}

    def add(name: str) -> None:
        for needed in STEPS[name][0]:
            add(needed)
        wanted.setdefault(name)

    for name in names:
        add(name)
    steps = ",\n".join(f"{name} AS ({STEPS[name][1]})" for name in wanted)
    return f"WITH {steps}\n{select}"
