"""Schemas of the input and result tables. Ids are 64-bit everywhere."""

USER_ACTIONS = "uid bigint, aid bigint, action string, action_date string"
ARTICLE_BASE = (
    "article_id bigint, article_num int, img_num int, type_name string, pub_gap int"
)
USER_BASE = "uid bigint, gender string, age int, email_suffix string"
ARTICLE_TERMS = "article_id bigint, top_term string, vector array<double>"
TRAINING = "uid bigint, aid bigint, label int"
LABELLED_CSV = "features string, label string"

DAILY_COUNTS = "uid bigint, aid bigint, action string, n bigint, day date"
RATINGS = "uid bigint, aid bigint, rating double"
ITEMCF = "uid bigint, sim_aid bigint, pred_rating double"
ALS = "uid bigint, pred_aid bigint, pred_rating double"
USER_VECTOR = "uid bigint, features array<double>"
ARTICLE_VECTOR = "article_id bigint, features array<double>"
EMBEDDING = "article_id bigint, article_vector array<double>"
MODEL = "feature string, value string, coefficient double"
CELLS = "rowkey string, family string, qualifier string, value string"
