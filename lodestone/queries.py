"""The registered queries of the library over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import perturb as P
from .functions import scores as S
from .functions import text as T
from .operators import fusion, metrics, resample, retrieval
from .plans import dialog, simulate
from .session import spread, table
from .streaming import sessions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ------------------------------------------------- tables as domain objects


def products(spark: SparkSession, sf: str) -> DataFrame:
    """part as a catalog."""
    p = spread(table(spark, sf, "part"))
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    return p.select(
        F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"),
        F.array(F.lit("Clothing, Shoes & Jewelry"), F.initcap("p_type"), F.element_at(F.split("p_name", " "), -1)).alias("categories"),
        F.array(F.concat(F.lit("  - "), "p_brand", F.lit("  quality. "))).alias("features"),
        F.array(entry("Size", F.col("p_size")), entry("Brand", F.col("p_brand"))).alias("details"),
        F.array(F.concat("p_name", F.lit(" of "), "p_brand")).alias("description"), F.col("p_brand").alias("store"), F.col("p_retailprice").alias("price"),
    )


#: Messages in the customers' templates, made of part: an opening in each scenario.
MESSAGES_SQL = """
SELECT p_partkey AS id, p_partkey % 4 AS kind,
  CASE p_partkey % 4
    WHEN 0 THEN concat('I''m looking for ', p_type, ' ', p_name, '. A key requirement is: ', p_brand, '; size: ', p_size, '.')
    WHEN 1 THEN concat('I''m looking for ', p_type, ' ', p_name, ', but I''m still exploring.')
    WHEN 2 THEN concat('I''m looking for ', p_type, ' ', p_name, '. budget around $', CAST(p_size AS VARCHAR), '.5')
    ELSE concat('For that, what matters is: color: ', split_part(p_name, ' ', 1), '; ', p_brand, '.')
  END AS message FROM part
"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    looking = F.concat(F.lit("I'm looking for "), "p_type", F.lit(" "), "p_name")
    made = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(looking, F.lit(". A key requirement is: "), "p_brand", F.lit("; size: "), F.col("p_size").cast("string"), F.lit(".")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(looking, F.lit(", but I'm still exploring.")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(looking, F.lit(". budget around $"), F.col("p_size").cast("string"), F.lit(".5")))
        .otherwise(F.concat(F.lit("For that, what matters is: color: "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("; "), "p_brand", F.lit(".")))
    )
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("kind"), made.alias("message"))


def corpus_index(spark: SparkSession, sf: str) -> retrieval.WordIndex:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.WordIndex(docs, {"text": 1.0})


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# Pieces of SQL that several queries share.
NORM = "lower(trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9_ \\t\\n\\f\\r$%.,:;''-]', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')))"
CLEAN = "rtrim(substr(trim(regexp_replace({0}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' -;,.' || chr(9) || chr(10)), 1, 180))"
STOP = _quoted(T.STOPWORDS)


#: Tokens of indexed text.
def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def norm_sql(x: str) -> str:
    return NORM.format(x)


def clean_sql(x: str) -> str:
    return CLEAN.format(x)


def bare_sql(x: str) -> str:
    """strip_boilerplate of normed text."""
    for phrase in T.BOILERPLATE:
        x = f"replace({x}, '{phrase.replace(chr(39), chr(39) * 2)}', ' ')"
    return f"trim(trim(regexp_replace({x}, '[ \\t\\n\\f\\r]+', ' ', 'g')), ' .,;:')"


# --------------------------------------------------------------------- text


@query(f"SELECT doc_id, {norm_sql('text')} AS normed FROM documents")
def norm_ascii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.norm_plain(F.col("text")).alias("normed"))


@query()
def norm_nfkc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.norm(F.col("text")).alias("normed"))


@query(f"SELECT p_partkey, {clean_sql(chr(39) + '  -- ' + chr(39) + ' || p_name || ' + chr(39) + '   ;  ' + chr(39) + ' || p_brand || ' + chr(39) + ' ..' + chr(39))} AS cleaned FROM part")
def clean_constraint(spark, sf):
    raw = F.concat(F.lit("  -- "), "p_name", F.lit("   ;  "), "p_brand", F.lit(" .."))
    return table(spark, sf, "part").select("p_partkey", T.clean_constraint(raw).alias("cleaned"))


@query("SELECT p_partkey, 'Size ' || p_size || ' Brand ' || p_brand AS details, p_name || ' ' || p_type AS listed FROM part")
def flatten_fields(spark, sf):
    p = table(spark, sf, "part")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    return p.select("p_partkey", T.flatten(F.array(entry("Size", F.col("p_size")), entry("Brand", F.col("p_brand"))), "entries").alias("details"), T.flatten(F.array("p_name", "p_type"), "list").alias("listed"))


FIELDS_SQL = f"""f AS (SELECT p_partkey, {norm_sql('p_name')} AS t, {norm_sql("'Clothing, Shoes & Jewelry ' || p_type || ' ' || split_part(p_name, ' ', -1)")} AS c,
      {norm_sql("'  - ' || p_brand || '  quality. '")} AS features, {norm_sql("'Size ' || p_size || ' Brand ' || p_brand")} AS details, {norm_sql('p_brand')} AS store, {norm_sql("p_name || ' of ' || p_brand")} AS description FROM part)"""
FIELDS = ("title", "categories", "features", "details", "store", "description")


@query(f"WITH {FIELDS_SQL} SELECT p_partkey, substr(concat_ws(' ', t, t, c, c, features, details, store, description), 1, 512) AS blob FROM f")
def product_blob(spark, sf):
    """The text that is embedded."""
    return products(spark, sf).select(F.col("ord").alias("p_partkey"), T.product_text(*map(F.col, FIELDS), cap=T.EMBEDDED_LENGTH, key=T.norm_plain).alias("blob"))


@query(f"WITH {FIELDS_SQL} SELECT p_partkey, substr(concat_ws(' ', t, t, c, c, features, details, store, description), 1, 900) AS blob FROM f")
def product_text(spark, sf):
    return products(spark, sf).select(F.col("ord").alias("p_partkey"), T.product_text(*map(F.col, FIELDS), key=T.norm_plain).alias("blob"))


@query("SELECT p_partkey, lower(concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)), ' ', split_part(p_name, ' ', -1))) AS phrase FROM part")
def coarse_bucket_phrase(spark, sf):
    return products(spark, sf).select(F.col("ord").alias("p_partkey"), T.phrase_key(T.coarse_category(F.col("categories"))).alias("phrase"))


@query(f"SELECT id, {bare_sql(norm_sql('message'))} AS bare FROM ({MESSAGES_SQL})")
def boilerplate_strip(spark, sf):
    return messages(spark, sf).select("id", T.strip_boilerplate(T.norm_plain(F.col("message"))).alias("bare"))


@query(
    f"""WITH n AS (SELECT doc_id, regexp_extract_all({norm_sql('text')}, '[a-z0-9]+') AS t FROM documents),
    e AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM n),
    f AS (SELECT doc_id, term, min(pos) AS pos FROM e WHERE length(term) > 1 AND term NOT IN ({STOP}) GROUP BY doc_id, term),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM f)
    SELECT doc_id, place, term FROM r WHERE place <= 24"""
)
def content_terms(spark, sf):
    terms = T.content_terms(T.norm_plain(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(terms).alias("p", "term")).select("doc_id", (F.col("p") + 1).cast("long").alias("place"), "term")


CLASSIFY_SQL = """CASE WHEN contains(low, 'budget') OR regexp_matches(low, '(\\$|<=|under)\\s*[0-9]') THEN 'budget'
 WHEN regexp_matches(low, 'cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric') THEN 'material'
 WHEN regexp_matches(low, 'color|black|white|blue|red|pink|green') THEN 'color'
 WHEN regexp_matches(low, 'size|sizing|width|wide|narrow') THEN 'size'
 WHEN regexp_matches(low, 'department|style|fit|sleeve|neck') THEN 'style'
 WHEN regexp_matches(low, 'hiking|running|gym|winter|outdoor|work') THEN 'use_case' ELSE 'feature' END"""


@query(f"SELECT doc_id, {CLASSIFY_SQL} AS attribute FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def classify_constraint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.classify_constraint(F.col("text")).alias("attribute"))


@query(
    f"""SELECT id, CASE WHEN regexp_matches(message, '(?i)what i need is:\\s*[^\\n.]+') THEN 'intent_override'
    WHEN regexp_matches(message, '(?i)\\bA key requirement is:\\s*.') THEN 'buying'
    WHEN regexp_matches(message, '(?i)\\bstill exploring\\b') THEN 'browsing_or_boundary' ELSE 'intent_override' END AS scenario
    FROM ({MESSAGES_SQL})"""
)
def route_scenario_t1(spark, sf):
    return messages(spark, sf).select("id", T.route_scenario(F.col("message"), F.lit(1), F.lit("unknown")).alias("scenario"))


@query(
    f"""WITH m AS (SELECT id, {norm_sql('message')} AS n, {bare_sql(norm_sql('message'))} AS bare FROM ({MESSAGES_SQL})),
    b AS (SELECT id, bare, regexp_extract(n, 'a key requirement is:\\s*(.+)', 1) AS x, regexp_extract(n, 'for that,? *what matters is:\\s*(.+)', 1) AS y FROM m),
    s AS (SELECT id, bare, list_filter(list_transform(list_concat(string_split(x, ';'), string_split(y, ';')), lambda c: trim(c, ' .,;')), lambda c: c <> '') AS l FROM b)
    SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE bare END AS constraints FROM s"""
)
def extract_constraints(spark, sf):
    return messages(spark, sf).select("id", F.array_join(T.marked_constraints(T.norm_plain(F.col("message"))), "|").alias("constraints"))


@query(
    f"""SELECT id, nullif(coalesce(nullif(regexp_extract(message, '(?is)^\\s*I''m\\s+looking\\s+for\\s+(.+?)\\.\\s+A\\s+key\\s+requirement\\s+is:\\s+.+?\\.\\s*$', 1), ''),
    nullif(regexp_extract(message, '(?is)^\\s*I''m\\s+looking\\s+for\\s+(.+?),\\s+but\\s+I''m\\s+still\\s+exploring\\.\\s*$', 1), ''),
    nullif(regexp_extract(message, '(?is)^\\s*I''m\\s+looking\\s+for\\s+(.+?)\\.\\s+.+?\\s*$', 1), '')), '') AS category FROM ({MESSAGES_SQL})"""
)
def category_phrase(spark, sf):
    return messages(spark, sf).select("id", T.category_phrase(F.col("message")).alias("category"))


@query(f"SELECT id, TRY_CAST(regexp_extract(message, '(?i)budget\\s+around\\s+\\$?([\\d.]+)', 1) AS DOUBLE) AS budget FROM ({MESSAGES_SQL})")
def budget_parse(spark, sf):
    return messages(spark, sf).select("id", T.parse_budget(F.col("message")).alias("budget"))


@query(
    f"""WITH m AS (SELECT id, message, regexp_extract(message, '(?i)\\bA key requirement is:\\s*(.+?)(?:\\.\\s*$|$)', 1) AS k,
    regexp_extract(message, '(?i)\\bFor that, what matters is:\\s*(.+?)(?:\\.\\s*$|$)', 1) AS w FROM ({MESSAGES_SQL})),
    l AS (SELECT id, CASE WHEN k <> '' THEN string_split(k, ';') WHEN w <> '' THEN string_split(w, ';') ELSE [message] END AS parts FROM m)
    SELECT id, array_to_string(list_filter(list_transform(parts, lambda p: {clean_sql('p')}), lambda c: c <> ''), '|') AS constraints FROM l"""
)
def exact_message_constraints(spark, sf):
    return messages(spark, sf).select("id", F.array_join(T.exact_constraints(F.col("message")), "|").alias("constraints"))


TITLE_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
VARIANTS = _quoted(T.TITLE_COLORS + T.TITLE_GENDERS + T.TITLE_SIZES)


@query(
    f"""WITH t AS (SELECT p_partkey, list_sort(list_distinct(string_split({TITLE_SQL.format("p_name || ' ' || p_brand")}, ' '))) AS l FROM part)
    SELECT p_partkey, array_to_string(l, ' ') AS tokens,
      array_to_string(list_filter(l, lambda x: x IN ({VARIANTS}) OR regexp_matches(x, '[0-9]')), ' ') AS variants FROM t"""
)
def title_tokens(spark, sf):
    tokens = T.title_tokens(T.title_key(F.concat("p_name", F.lit(" "), "p_brand"), unicode=False))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"), F.array_join(T.variant_tokens(tokens), " ").alias("variants"))


@query(
    f"""WITH m AS (SELECT id, list_distinct(regexp_extract_all(lower(message), '[a-z0-9]+')) AS l FROM ({MESSAGES_SQL}))
    SELECT id, array_to_string(list_sort(list_filter(l, lambda x: x NOT IN ({_quoted(T.CANDIDATE_STOPWORDS)}))), ' ') AS tokens FROM m"""
)
def candidate_tokens(spark, sf):
    return messages(spark, sf).select("id", F.array_join(F.array_sort(T.candidate_tokens(F.col("message"))), " ").alias("tokens"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat_ws('|', event_type, 'u' || user_id) AS listed FROM events")
def json_props(spark, sf):
    """A number of a JSON object; and the strings of a list in a fence, numbers and nulls left out."""
    reply = F.format_string('```json\n{"constraints": ["%s", %s, null, "u%s"]}\n```', "event_type", F.get_json_object("props", "$.k"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_join(T.json_strings(reply), "|").alias("listed"))


@query("SELECT p_partkey, printf('$%.2f', p_retailprice) AS price FROM part")
def price_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.price_text(F.col("p_retailprice")).alias("price"))


QUESTION_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.QUESTIONS.items())


@query(
    f"""SELECT p_partkey, CASE attribute {QUESTION_SQL} ELSE '{T.QUESTIONS["other"]}' END AS prompt FROM
    (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'budget' WHEN 2 THEN 'brand' ELSE 'other' END AS attribute FROM part)"""
)
def question_prompt(spark, sf):
    k = F.col("p_partkey") % 4
    attribute = F.when(k == 0, "color").when(k == 1, "budget").when(k == 2, "brand").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", T.question_prompt(attribute).alias("prompt"))


@query(
    """SELECT conv_id, turn, CASE WHEN asked < 2 THEN 'other' ELSE ['feature', 'material', 'color', 'style'][1 + (asked - 2) % 4] END AS attribute
    FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS asked FROM conversations WHERE role = 'user')"""
)
def question_policy(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    asked = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return c.withColumn("asked", asked).select("conv_id", "turn", T.next_attribute(F.col("asked"), "other_twice_rotate").alias("attribute"))


DOUBTS = [" instead", "", ", make that wool", " with a belt", ", no longer red", " for work"]


@query(f"SELECT p_partkey, regexp_matches(p_name || [{_quoted(DOUBTS)}][1 + p_partkey % 6], '{T.POSSIBLE_OVERRIDE}') AS maybe FROM part")
def override_prefilter(spark, sf):
    said = F.concat("p_name", F.get(F.array(*[F.lit(d) for d in DOUBTS]), (F.col("p_partkey") % 6).cast("int")))
    return table(spark, sf, "part").select("p_partkey", T.maybe_override(said).alias("maybe"))


@query(
    f"""WITH m AS (SELECT id, message, regexp_extract(message, '(?i)\\bA key requirement is:\\s*(.+?)(?:\\.\\s*$|$)', 1) AS k,
    regexp_extract(message, '(?i)\\bFor that, what matters is:\\s*(.+?)(?:\\.\\s*$|$)', 1) AS w FROM ({MESSAGES_SQL})),
    l AS (SELECT id, list_filter(list_transform(CASE WHEN k <> '' THEN string_split(k, ';') WHEN w <> '' THEN string_split(w, ';') ELSE [message] END, lambda p: {clean_sql('p')}), lambda c: c <> '') AS l FROM m),
    b AS (SELECT id, list_transform(list_transform(l, lambda x: trim(x, ' -;,.')), lambda c: CASE WHEN contains(c, ':') AND length(split_part(c, ':', 1)) <= 20 AND lower(trim(split_part(c, ':', 1))) = 'color' AND trim(substr(c, strpos(c, ':') + 1)) <> ''
      THEN trim(substr(c, strpos(c, ':') + 1)) || ' color' ELSE c END) AS l FROM l),
    d AS (SELECT id, list_filter(l, lambda x, i: x <> '' AND list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:2] AS l FROM b),
    w AS (SELECT id, CASE WHEN len(l) > 0 THEN '{T.REASON}' || array_to_string(l, ' and ') || '.' ELSE '{T.NO_REASON}' END AS why,
      CASE WHEN id % 100 >= 65 THEN '{T.STRONG}' WHEN id % 100 <= 25 THEN '{T.NARROWING}' ELSE '{T.CLOSEST}' END || '{T.OPEN_QUESTION}' AS tail FROM d)
    SELECT id, CASE WHEN length(why) <= 240 - length(tail) THEN why ELSE rtrim(substr(why, 1, 239 - length(tail))) || '…' END || tail AS message FROM w"""
)
def explanation_text(spark, sf):
    said = T.exact_constraints(F.col("message"))
    return messages(spark, sf).select("id", T.explanation(said, (F.col("id") % 100) / 100.0).alias("message"))


BELOW_100_SQL = f"CASE WHEN {{0}} < 20 THEN [{_quoted(T.ONES)}][1 + {{0}}] ELSE ['', '', {_quoted(T.TENS)}][1 + {{0}} // 10] || CASE WHEN {{0}} % 10 > 0 THEN '-' || [{_quoted(T.ONES)}][1 + {{0}} % 10] ELSE '' END END"


@query(
    f"""WITH p AS (SELECT p_partkey, p_retailprice % 1000 AS x, CAST(floor(p_retailprice % 1000) AS INTEGER) AS v FROM part)
    SELECT p_partkey, CASE WHEN x <> v THEN regexp_replace(printf('%.6f', x), '\\.?0+$', '') WHEN v < 100 THEN {BELOW_100_SQL.format('v')}
    ELSE [{_quoted(T.ONES)}][1 + v // 100] || ' hundred' || CASE WHEN v % 100 > 0 THEN ' ' || {BELOW_100_SQL.format('(v % 100)')} ELSE '' END END AS words FROM p"""
)
def number_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.number_words(F.col("p_retailprice") % 1000).alias("words"))


@query()
def paraphrase_levels(spark, sf):
    m = messages(spark, sf)
    other = P.reworded_constraint(P.constraint_body(F.col("message")))
    out = None
    for level in range(5):
        one = m.select("id", F.lit(level).alias("level"), "message", P.paraphrase(F.col("message"), other, level).alias("perturbed"))
        out = one if out is None else out.union(one)
    return out.withColumn("changed", P.constraint_changed(F.col("message"), F.col("perturbed")))


# --------------------------------------------------------- index and routes

BM25_CORPUS = f"""
tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
lens AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS len FROM tok GROUP BY doc_id),
alldocs AS (SELECT d.doc_id, coalesce(len, 0) AS len FROM documents d LEFT JOIN lens USING (doc_id)),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean_len FROM alldocs),
said AS (SELECT item_id AS query_id, {bare_sql(norm_sql('text'))} AS s FROM benchmark),
qtok AS (SELECT query_id, t, pos FROM (SELECT query_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT query_id, regexp_extract_all({norm_sql('s')}, '[a-z0-9]+') AS l FROM said))),
qfirst AS (SELECT query_id, t AS term, min(pos) AS pos FROM qtok WHERE length(t) > 1 AND t NOT IN ({STOP}) GROUP BY 1, 2),
qterm AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM qfirst) WHERE r <= 24),
hits AS (SELECT term, doc_id, CAST(count(*) AS DOUBLE) AS tf FROM tok WHERE term IN (SELECT term FROM qterm) GROUP BY 1, 2),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM hits GROUP BY 1),
w AS (SELECT h.term, h.doc_id, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
  * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean_len)) AS weight FROM hits h JOIN df USING (term) JOIN alldocs USING (doc_id) CROSS JOIN size),
need AS (SELECT query_id, count(*) AS need FROM qterm GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(weight), 6) AS score, count(*) AS met FROM qterm JOIN w USING (term) GROUP BY 1, 2)
"""
PHRASE_CORPUS = f"""
d AS (SELECT doc_id, ' ' || array_to_string({tokens_sql('text')}, '  ') || ' ' AS line FROM documents),
q AS (SELECT query_id, unnest(list_filter(list_transform(string_split(s, ';;;'), lambda c: array_to_string(regexp_extract_all(c, '[a-z0-9]+'), '  ')), lambda c: c <> '')) AS ph FROM (SELECT item_id AS query_id, {bare_sql(norm_sql('text'))} AS s FROM benchmark)),
plens AS (SELECT doc_id, CAST(len({tokens_sql('text')}) AS DOUBLE) AS len FROM documents),
psize AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean_len FROM plens),
ptf AS (SELECT ph, doc_id, CAST((length(line) - length(replace(line, ' ' || ph || ' ', ''))) / (length(ph) + 2) AS DOUBLE) AS tf FROM (SELECT DISTINCT ph FROM q) JOIN d ON contains(line, ' ' || ph || ' ')),
pdf AS (SELECT ph, CAST(count(*) AS DOUBLE) AS df FROM ptf GROUP BY 1),
ps AS (SELECT query_id, doc_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
  * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean_len))), 6) AS score FROM q JOIN ptf USING (ph) JOIN pdf USING (ph) JOIN plens USING (doc_id) CROSS JOIN psize GROUP BY 1, 2)
"""


@query(
    f"""WITH {BM25_CORPUS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def bm25_top10(spark, sf):
    return retrieval.bm25(benchmark_queries(spark, sf), corpus_index(spark, sf), 10, digits=6)


@query(
    f"""WITH {BM25_CORPUS}, r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN need USING (query_id) WHERE met = need)
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def bm25_and_tier(spark, sf):
    return retrieval.bm25(benchmark_queries(spark, sf), corpus_index(spark, sf), 10, all_of=True, digits=6)


@query(
    f"""WITH {PHRASE_CORPUS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ps)
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def bm25_phrase_tier(spark, sf):
    return retrieval.bm25_phrase(benchmark_queries(spark, sf), corpus_index(spark, sf), 10, digits=6)


@query(
    f"""WITH {BM25_CORPUS}, {PHRASE_CORPUS},
    tiers AS (SELECT 0 AS tier, query_id, doc_id, score FROM ps UNION ALL SELECT 1, query_id, doc_id, score FROM s JOIN need USING (query_id) WHERE met = need UNION ALL SELECT 2, query_id, doc_id, score FROM s),
    places AS (SELECT *, row_number() OVER (PARTITION BY tier, query_id ORDER BY score DESC, doc_id) AS place FROM tiers),
    first AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY tier) AS seen FROM places WHERE place <= 50),
    r AS (SELECT query_id, doc_id, score + CAST(1000.0 AS DOUBLE) * (3 - tier) AS score, row_number() OVER (PARTITION BY query_id ORDER BY tier, place) AS rank FROM first WHERE seen = 1)
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50"""
)
def bm25_cascade(spark, sf):
    return retrieval.bm25_cascade(benchmark_queries(spark, sf), corpus_index(spark, sf), 50, digits=6)


@query(
    f"""WITH tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents)
    SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS uses FROM tok GROUP BY term"""
)
def postings_stats(spark, sf):
    p = retrieval.postings(corpus_index(spark, sf).tokens)
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))


def part_fields(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    none = F.lit("")
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_type").alias("categories"), none.alias("features"), none.alias("details"), F.col("p_brand").alias("store"), none.alias("description"))


@query(
    """WITH f AS (SELECT p_partkey AS doc_id, 10.0 AS weight, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS term FROM part UNION ALL
      SELECT p_partkey, 12.0, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) FROM part UNION ALL
      SELECT p_partkey, 1.5, unnest(regexp_extract_all(lower(p_brand), '[a-z0-9]+')) FROM part),
    lens AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS len FROM f GROUP BY 1), size AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean_len FROM lens),
    q AS (SELECT DISTINCT query_id, term FROM (SELECT n_nationkey AS query_id, unnest(['promo', CASE WHEN n_nationkey % 2 = 0 THEN 'red' ELSE 'blue' END, 'gear', CAST(n_nationkey AS VARCHAR)]) AS term FROM nation) WHERE length(term) > 1),
    h AS (SELECT term, doc_id, sum(weight) AS tf FROM f WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM h GROUP BY 1),
    s AS (SELECT query_id, doc_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
      * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean_len))), 6) AS score FROM q JOIN h USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN size GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def bm25_fielded_top10(spark, sf):
    n = table(spark, sf, "nation")
    colour = F.when(F.col("n_nationkey") % 2 == 0, "red").otherwise("blue")
    q = n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat_ws(" ", F.lit("promo"), colour, F.lit("gear"), F.col("n_nationkey").cast("string")).alias("query"))
    return retrieval.bm25(q, retrieval.WordIndex(part_fields(spark, sf), retrieval.WEIGHTS), 10, digits=6)


@query(
    """WITH d AS (SELECT p_partkey AS id, p_name || ' ' || lower(p_brand) AS text FROM part), q AS (SELECT n_nationkey AS id, lower(n_name) || ' gear ring' AS text FROM nation),
    words AS (SELECT 'd' AS side, id, ' ' || unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) || ' ' AS w FROM d UNION ALL
      SELECT 'q', id, ' ' || unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) || ' ' FROM q),
    g AS (SELECT side, id, substr(w, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS gram FROM words, range(3, 6) t(n), range(1, 40) u(i) WHERE i + n - 1 <= length(w)),
    tf AS (SELECT side, id, gram, CAST(count(*) AS DOUBLE) AS tf FROM g GROUP BY 1, 2, 3),
    df AS (SELECT gram, CAST(count(*) AS DOUBLE) AS df FROM tf WHERE side = 'd' GROUP BY 1 HAVING count(*) >= 3),
    idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1 AS idf FROM df),
    raw AS (SELECT side, id, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (gram)), norm AS (SELECT side, id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1, 2),
    v AS (SELECT side, id, gram, w / norm AS w FROM raw JOIN norm USING (side, id)),
    s AS (SELECT a.id AS query_id, b.id AS doc_id, round(sum(a.w * b.w), 6) AS score FROM v a JOIN v b ON a.gram = b.gram AND a.side = 'q' AND b.side = 'd' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND score > 0"""
)
def ngram_tfidf_top10(spark, sf):
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("text"))
    q = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lower("n_name"), F.lit(" gear ring")).alias("query"))
    return retrieval.ngram_route(q, docs, 10, digits=6)


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


DENSE_SQL = """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
  list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(d.embedding[i] AS DOUBLE))) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
  SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


@query(DENSE_SQL)
def dense_cosine_top10(spark, sf):
    """Queries are the vectors whose id is divisible by 20, against all."""
    v = _vectors(spark, sf)
    q = v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    near = retrieval.dense_route(q, v, 11)
    return retrieval.ranked(near.withColumn("score", F.round("score", 6)).drop("rank"), 10)


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) /
    greatest(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 1e-16), 6) AS squared_norm FROM embeddings"""
)
def dense_sanitize(spark, sf):
    unit = S.unit_vector(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.dot(unit, unit), 6).alias("squared_norm"))


@query("SELECT DISTINCT key, p_partkey FROM (SELECT p_partkey, unnest([p_brand || '  quality', lower(p_brand) || '  quality', 'Size: ' || p_size, 'size: ' || p_size, 'Brand: ' || p_brand, lower('Brand: ' || p_brand)]) AS key FROM part) WHERE NOT contains(key, '  ') UNION SELECT p_brand || ' quality', p_partkey FROM part UNION SELECT lower(p_brand) || ' quality', p_partkey FROM part")
def exact_index(spark, sf):
    return retrieval.exact_keys(products(spark, sf)).select("key", F.col("ord").alias("p_partkey"))


def exact_questions(spark, sf) -> DataFrame:
    """Three constraints for each nation: a brand, a budget, and one that no index knows."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    asked = F.array(
        F.concat(F.lit("brand: Brand#"), (k % 5 + 1).cast("string")), F.concat(F.lit("budget around $"), (k * 20 + 700).cast("string")),
        F.lit("color: chartreuse"), F.lit("nothing knows this"), F.when(k % 2 == 0, F.concat(F.lit("Size: "), (k + 1).cast("string"))).otherwise(""),
    )
    return n.select(k.cast("long").alias("query_id"), F.explode(asked).alias("constraint"))


EXACT_SQL = """
q AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'Brand#' || (n_nationkey % 5 + 1) AS brand, (n_nationkey * 20 + 700) * CAST(1.15 AS DOUBLE) AS most, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 1 END AS size FROM nation),
m AS (SELECT query_id, p_partkey FROM q JOIN part ON (p_brand = brand) AND p_retailprice <= most AND (size IS NULL OR p_size = size))
"""


def _exact(spark, sf, asked: DataFrame) -> DataFrame:
    p = products(spark, sf)
    text = simulate.searchable_text(*[F.col(c) for c in ("title", "features", "details", "description", "categories", "store")])
    prices = p.filter("price > 0").select("doc_id", "ord", "price")
    return retrieval.exact_matches(asked, retrieval.exact_keys(p), retrieval.material_hits(p, text), prices)


@query(f"WITH {EXACT_SQL} SELECT query_id, p_partkey FROM m")
def exact_intersection(spark, sf):
    # the index has "Brand: Brand#1" and its lower case; a query in mixed case meets the lower-case alias
    return _exact(spark, sf, exact_questions(spark, sf)).select("query_id", F.col("ord").alias("p_partkey"))


@query(f"WITH {EXACT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS rank FROM m) SELECT query_id, CAST(p_partkey AS VARCHAR) AS doc_id, CAST(1 AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def exact_limit_order(spark, sf):
    return retrieval.in_catalog_order(_exact(spark, sf, exact_questions(spark, sf)), 5)


@query("SELECT n_nationkey AS query_id, CAST(count(*) AS BIGINT) AS parts FROM nation JOIN part ON p_retailprice > 0 AND p_retailprice <= (n_nationkey * 40 + 600) * CAST(1.15 AS DOUBLE) GROUP BY 1")
def budget_range_join(spark, sf):
    c = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), ((F.col("n_nationkey") * 40 + 600) * retrieval.BUDGET_TOLERANCE).alias("most"))
    p = table(spark, sf, "part").filter("p_retailprice > 0").select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("price"))
    return retrieval.within_budget(c, p).groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"))


@query(f"SELECT m.key, p_partkey FROM part JOIN (SELECT unnest([{_quoted(T.EXACT_MATERIALS)}]) AS key) m ON regexp_matches(lower(p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'Wool blend' ELSE 'woolly' END), '\\b' || m.key || '\\b')")
def material_index(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, "Wool blend").otherwise("woolly")).alias("t"))
    return retrieval.material_hits(p, F.col("t")).select("key", F.col("doc_id").alias("p_partkey"))


CANDIDATE_TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[a-z0-9]+')), lambda x: x NOT IN ({_quoted(T.CANDIDATE_STOPWORDS)}))"


@query(
    f"""WITH k AS (SELECT key, min(p_partkey) AS first FROM (SELECT p_partkey, unnest([f, lower(f), s, lower(s), b, lower(b)]) AS key FROM
      (SELECT p_partkey, {clean_sql("'  - ' || p_brand || '  quality. '")} AS f, 'Size: ' || p_size AS s, 'Brand: ' || p_brand AS b FROM part)) GROUP BY key),
    kt AS (SELECT key, first, len(t) AS n, unnest(t) AS token FROM (SELECT key, first, {CANDIDATE_TOKENS.format('key')} AS t FROM k) WHERE len(t) > 0),
    m AS (SELECT id, message FROM ({MESSAGES_SQL})),
    mt AS (SELECT id, unnest({CANDIDATE_TOKENS.format('message')}) AS token FROM m),
    o AS (SELECT id, key, first, n, CAST(count(*) AS INTEGER) AS shared FROM mt JOIN kt USING (token) GROUP BY 1, 2, 3, 4),
    c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first, key) AS place FROM o),
    price AS (SELECT id, regexp_extract(message, '{T.PRICE_LANGUAGE}', 1) AS amount FROM m),
    r AS (SELECT id, key AS candidate, shared, CAST(shared AS DOUBLE) / n AS coverage FROM c WHERE place <= 256
      UNION ALL SELECT id, 'budget around $' || amount, 90, 1.0 FROM price WHERE amount <> ''
      UNION ALL SELECT id, x.key, 100, 1.0 FROM m JOIN (SELECT unnest([{_quoted(T.EXACT_MATERIALS)}]) AS key) x ON regexp_matches(lower(message), '\\b' || x.key || '\\b')),
    one AS (SELECT *, row_number() OVER (PARTITION BY id, lower(candidate) ORDER BY shared DESC, coverage DESC, length(candidate), lower(candidate), candidate) AS one_of FROM (SELECT id, {clean_sql('candidate')} AS candidate, shared, coverage FROM r) WHERE candidate <> ''),
    t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, coverage DESC, length(candidate), lower(candidate)) AS rank FROM one WHERE one_of = 1)
    SELECT id AS query_id, lower(candidate) AS candidate, shared, coverage, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 32"""
)
def catalog_candidates(spark, sf):
    keys = retrieval.exact_keys(products(spark, sf)).groupBy("key").agg(F.min("ord").alias("first"))
    keys = keys.select("key", F.struct("first", "key").alias("key_ord"))
    m = messages(spark, sf).select(F.col("id").alias("query_id"), "message")
    return retrieval.catalog_candidates(m, keys).withColumn("candidate", F.lower("candidate"))


@query("SELECT phrase, CAST(count(*) AS BIGINT) AS parts FROM (SELECT lower(p_type) || ' ' || split_part(p_name, ' ', -1) AS phrase FROM part) GROUP BY phrase")
def bucket_table(spark, sf):
    return retrieval.bucket_table(products(spark, sf)).groupBy("phrase").agg(F.count(F.lit(1)).alias("parts"))


BUCKET_SQL = """
b AS (SELECT p_partkey, lower(p_type) || ' ' || split_part(p_name, ' ', -1) AS phrase FROM part),
q AS (SELECT n_nationkey AS query_id, ['economy ring', 'promo gear', 'small bolt', 'no such thing'][1 + n_nationkey % 4] AS phrase FROM nation),
m AS (SELECT CAST(query_id AS BIGINT) AS query_id, p_partkey FROM q JOIN b USING (phrase))
"""


def _bucket_messages(spark, sf) -> DataFrame:
    phrases = F.array(*[F.lit(x) for x in ("Economy  Ring", "Promo Gear", "Small Bolt", "no such thing")])
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.cast("long").alias("query_id"), F.concat(F.lit("I'm looking for "), F.get(phrases, (k % 4).cast("int")), F.lit(", but I'm still exploring.")).alias("message"))


@query(f"WITH {BUCKET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS rank FROM m) SELECT query_id, CAST(p_partkey AS VARCHAR) AS doc_id, CAST(1 AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def bucket_route(spark, sf):
    return retrieval.in_catalog_order(retrieval.bucket_matches(_bucket_messages(spark, sf), retrieval.bucket_table(products(spark, sf))), 10)


@query(
    f"""WITH {BUCKET_SQL}, pool AS (SELECT CAST(c_nationkey AS BIGINT) AS query_id, c_custkey AS p_partkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS rank FROM customer),
    f AS (SELECT pool.*, m.p_partkey IS NOT NULL AS hit FROM pool LEFT JOIN (SELECT DISTINCT * FROM m) m USING (query_id, p_partkey)),
    a AS (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM f)
    SELECT query_id, CAST(p_partkey AS VARCHAR) AS doc_id, rank FROM a WHERE hit OR NOT any_hit"""
)
def category_filter_nonempty(spark, sf):
    # every nation's pool: the parts with the numbers of its customers
    m = _bucket_messages(spark, sf)
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    pool = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").cast("string").alias("doc_id"), place.alias("rank"))
    return retrieval.bucket_filter(pool, retrieval.bucket_matches(m, retrieval.bucket_table(products(spark, sf)))).select("query_id", "doc_id", "rank")


@query("SELECT band, CAST(count(*) AS BIGINT) AS buckets FROM (SELECT CASE WHEN n <= 10 THEN '<=10' WHEN n <= 50 THEN '11-50' WHEN n <= 500 THEN '51-500' ELSE '>500' END AS band FROM (SELECT count(*) AS n FROM part GROUP BY p_type, p_name)) GROUP BY band")
def bucket_band_hist(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_type", "p_name").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(retrieval.bucket_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("buckets"))


@query(
    """WITH s AS (SELECT count(*) AS size FROM part GROUP BY lower(p_type) || ' ' || split_part(p_name, ' ', -1)),
    b AS (SELECT *, CASE WHEN size <= 10 THEN '<=10' WHEN size <= 50 THEN '11-50' WHEN size <= 500 THEN '51-500' ELSE '>500' END AS band FROM s)
    SELECT band, CAST(count(*) AS BIGINT) AS buckets, CAST(min(size) AS BIGINT) AS least, CAST(median(size) AS DOUBLE) AS median, avg(size) AS mean, CAST(max(size) AS BIGINT) AS most FROM b GROUP BY GROUPING SETS ((band), ())"""
)
def bucket_statistics(spark, sf):
    return metrics.bucket_statistics(retrieval.bucket_table(products(spark, sf)))


# ------------------------------------------------------------------- fusion
# Ranked lists: a customer's orders by price (a route), by date (another one), by key (a third).

ROUTES_SQL = """
a AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_orderstatus AS status, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
b AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P')
"""


def routes(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"), "o_orderdate", "o_orderstatus")
    w = Window.partitionBy("query_id")
    a = o.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))).select("query_id", "doc_id", "score", "rank", F.col("o_orderstatus").alias("status"))
    b = o.filter("o_orderstatus <> 'P'").withColumn("rank", F.row_number().over(w.orderBy("o_orderdate", "doc_id"))).select("query_id", "doc_id", "score", "rank")
    return a, b


@query(f"WITH {ROUTES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM a) SELECT query_id, doc_id, CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 - (rank - 1) / CAST(n - 1 AS DOUBLE) END AS score FROM n")
def rank_normalize(spark, sf):
    a, _ = routes(spark, sf)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return a.withColumn("n", n).select("query_id", "doc_id", S.rank_score(F.col("rank"), F.col("n")).alias("score"))


@query(f"WITH {ROUTES_SQL}, n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM a WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, CASE WHEN hi - lo <= 1e-9 * greatest(abs(hi), abs(lo)) THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score FROM n")
def minmax_normalize(spark, sf):
    a, _ = routes(spark, sf)
    return a.select("query_id", "doc_id", S.minmax(F.col("score"), ["query_id"]).alias("score"))


@query(
    f"""WITH {ROUTES_SQL}, p AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM a WHERE rank <= 500),
    s AS (SELECT p.query_id, p.doc_id, p.rank AS base_rank, CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 - (p.rank - 1) / CAST(n - 1 AS DOUBLE) END
      + CASE WHEN p.status = 'F' THEN 0.35 ELSE 0 END + CASE WHEN b.doc_id IS NOT NULL THEN 0.1 ELSE 0 END AS score
      FROM p LEFT JOIN b ON p.query_id = b.query_id AND p.doc_id = b.doc_id AND b.rank <= 3)
    SELECT query_id, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, base_rank) AS INTEGER) AS rank FROM s"""
)
def fuse_pool(spark, sf):
    a, b = routes(spark, sf)
    fused = fusion.fuse_pool(a, exact=a.filter("status = 'F'"), bucket=b.filter("rank <= 3"))
    again = fused.withColumn("score", F.round("score", 9))
    return retrieval.top_k(again, 500, ["query_id"], [F.desc("score"), F.asc("base_rank")]).select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH {ROUTES_SQL}, u AS (SELECT query_id, doc_id, CAST(1.0 AS DOUBLE) / (60 + rank) AS s, 0 AS list, rank FROM a UNION ALL SELECT query_id, doc_id, CAST(0.5 AS DOUBLE) / (60 + rank), 1, rank FROM b),
    g AS (SELECT query_id, doc_id, round(sum(s), 9) AS score, min(list * 100000 + rank) AS seen FROM u GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM g)
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def rrf_fusion(spark, sf):
    a, b = routes(spark, sf)
    return fusion.rrf([(a, 1.0), (b, 0.5)], limit=10, digits=9)


@query(f"WITH {ROUTES_SQL} SELECT query_id, doc_id FROM a WHERE rank <= 3 UNION SELECT query_id, doc_id FROM b WHERE rank <= 3")
def union_ceiling(spark, sf):
    a, b = routes(spark, sf)
    return fusion.union_of([a.filter("rank <= 3"), b.filter("rank <= 3")])


@query(
    f"""WITH {ROUTES_SQL}, j AS (SELECT a.query_id, a.doc_id, a.rank, CASE WHEN a.query_id % 2 = 0 THEN NULL ELSE b.rank END AS near FROM a LEFT JOIN b USING (query_id, doc_id))
    SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY near IS NULL, near DESC, rank) AS INTEGER) AS new_rank FROM j"""
)
def dense_rescore(spark, sf):
    a, b = routes(spark, sf)
    near = b.withColumn("score", F.col("rank").cast("double"))
    return fusion.dense_rescore(a, near, gate=F.col("query_id") % 2 != 0).select("query_id", "doc_id", "new_rank")


@query(
    """SELECT p_partkey, round(-CAST(p_size AS DOUBLE) * 0.01 + 2.0 * (CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'gear') THEN 1 ELSE 0 END) / 2
    - 0.002 * len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) + 0.1 * (p_retailprice / 1000) / 5.0, 9) AS score FROM part"""
)
def feature_rescore(spark, sf):
    wanted = F.array(F.lit("ring of"), F.lit("gear"))
    s = fusion.feature_score(F.col("p_size") + 1, F.col("p_name"), wanted, (F.col("p_retailprice") / 1000).cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.round(s, 9).alias("score"))


@query(
    f"""WITH {ROUTES_SQL}, z AS (SELECT query_id, score / 100000 AS s FROM a), m AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS hi FROM z),
    e AS (SELECT query_id, exp(s - hi) AS e, sum(exp(s - hi)) OVER (PARTITION BY query_id) AS t FROM m), p AS (SELECT query_id, e / t AS p FROM e)
    SELECT query_id, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 + sum(p * ln(p)) / ln(count(*)))) END, 9) AS confidence FROM p GROUP BY query_id"""
)
def softmax_confidence(spark, sf):
    a, _ = routes(spark, sf)
    out = fusion.confidence(a.withColumn("score", F.col("score") / 100000))
    return out.select("query_id", F.round("confidence", 9).alias("confidence"))


# ----------------------------------------------------------- filters, sets


@query(f"WITH {ROUTES_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = a.query_id AND b.doc_id = a.doc_id AND b.rank <= 5)")
def freshness_anti_join(spark, sf):
    a, b = routes(spark, sf)
    return fusion.fresh(a, b.filter("rank <= 5")).select("query_id", "doc_id", "rank")


@query(
    """WITH g AS (SELECT user_id AS query_id, CAST(event_id % 300 AS VARCHAR) AS doc_id, min(event_id) AS pos FROM events WHERE event_id % 300 IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM g) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def valid_recommendations(spark, sf):
    given = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.concat(F.lit(" "), (F.col("event_id") % 300).cast("string")).alias("doc_id"), F.col("event_id").alias("pos"))
    known = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("doc_id"))
    return fusion.valid_recommendations(given, known).select("query_id", "doc_id", "rank")


@query("SELECT user_id, event_type, CAST(min(event_id) AS BIGINT) AS pos FROM events GROUP BY 1, 2")
def ordered_distinct(spark, sf):
    return fusion.ordered_distinct(table(spark, sf, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", F.col("event_id").alias("pos"))


@query(
    f"""WITH t AS (SELECT DISTINCT list_sort(list_distinct(string_split({TITLE_SQL.format("p_name || ' ' || p_type || ' ' || p_brand || ' size'")}, ' '))) AS l FROM part)
    SELECT array_to_string(a.l, ' ') AS a, array_to_string(b.l, ' ') AS b, round(len(list_intersect(a.l, b.l)) / CAST(len(list_distinct(list_concat(a.l, b.l))) AS DOUBLE), 6) AS similarity
    FROM t a JOIN t b ON a.l < b.l WHERE len(list_intersect(a.l, b.l)) >= CAST(0.7 AS DOUBLE) * len(list_distinct(list_concat(a.l, b.l)))"""
)
def near_dup_pairs(spark, sf):
    titles = table(spark, sf, "part").select(F.lit(1).alias("pool_id"), F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("size")).alias("title"))
    pairs, _ = fusion.near_duplicate_pairs(titles, 0.7)
    join = lambda c: F.array_join(c, " ")
    return pairs.filter("ta < tb").select(join("ta").alias("a"), join("tb").alias("b"), F.round("similarity", 6).alias("similarity"))


@query()
def diverse_topk(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), (F.col("o_orderkey") % 200).alias("p_partkey"))
    # remainders of 200 are all that a title is asked for by
    named = table(spark, sf, "part").filter("p_partkey > -200 AND p_partkey < 200").select("p_partkey", F.col("p_name").alias("title"))
    pool = o.join(F.broadcast(named), "p_partkey").drop("p_partkey")
    return fusion.diverse_top_k(pool, 10, 0.5)


# ------------------------------------------------------------------ metrics
# Session outcomes: an order is a session. Rank 1 to 10 or none, turn 1 to 10.

SESSION_SQL = """
s0 AS (SELECT o_orderkey AS sample_id, ['buying', 'browsing', 'intent_override', 'boundary'][1 + o_orderkey % 4] AS scenario_type, o_orderkey % 3 <> 0 AS hit, CAST(1 + o_orderkey % 10 AS INTEGER) AS rk, CAST(1 + o_custkey % 10 AS INTEGER) AS tn, CAST(1 + (o_orderkey + o_custkey) % 10 AS INTEGER) AS rk2, (o_orderkey + o_custkey) % 4 <> 0 AS hit2 FROM orders),
s AS (SELECT sample_id, scenario_type, hit, CASE WHEN hit THEN tn END AS first_hit_turn, CASE WHEN hit THEN rk END AS best_rank, CASE WHEN hit THEN CAST(1.0 AS DOUBLE) / rk ELSE 0.0 END AS reciprocal_rank FROM s0),
s2 AS (SELECT sample_id, scenario_type, hit2 AS hit, CASE WHEN hit2 THEN tn END AS first_hit_turn, CASE WHEN hit2 THEN rk2 END AS best_rank, CASE WHEN hit2 THEN CAST(1.0 AS DOUBLE) / rk2 ELSE 0.0 END AS reciprocal_rank FROM s0)
"""


def outcomes(spark, sf, second: bool = False) -> DataFrame:
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(x) for x in resample.SCENARIOS])
    hit = ((key + cust) % 4 != 0) if second else (key % 3 != 0)
    rank = (1 + ((key + cust) if second else key) % 10).cast("int")
    o = o.select(key.alias("sample_id"), F.get(names, (key % 4).cast("int")).alias("scenario_type"), hit.alias("hit"), rank.alias("rk"), (1 + cust % 10).cast("int").alias("tn"))
    when = lambda c: F.when(F.col("hit"), F.col(c))
    return o.select("sample_id", "scenario_type", "hit", when("tn").alias("first_hit_turn"), when("rk").alias("best_rank"), F.when(F.col("hit"), 1.0 / F.col("rk")).otherwise(0.0).alias("reciprocal_rank"))


@query(
    f"""WITH {SESSION_SQL}, m AS (SELECT scenario_type, CAST(count(*) AS BIGINT) AS sample_count, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_10, round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)), 6) AS mttc FROM s GROUP BY GROUPING SETS ((scenario_type), ()))
    SELECT *, round(greatest(0.0, least(1.0, (11.0 - mttc) / 10.0)), 6) AS efficiency, round(0.5 * hit_rate_at_10 + 0.3 * mrr + 0.2 * greatest(0.0, least(1.0, (11.0 - mttc) / 10.0)), 6) AS technical_score FROM m"""
)
def session_metrics_rollup(spark, sf):
    return metrics.session_metrics(outcomes(spark, sf))


RECALL_SQL = f"""WITH {ROUTES_SQL}, c AS (SELECT o_custkey AS query_id, max(o_orderkey) AS target, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS scenario FROM orders GROUP BY o_custkey),
 r AS (SELECT c.*, k, CASE WHEN a.rank <= k THEN 1.0 ELSE 0.0 END AS hit FROM c LEFT JOIN a ON a.query_id = c.query_id AND a.doc_id = c.target CROSS JOIN (SELECT unnest([1, 3, 10]) AS k))
 SELECT k, scenario, CAST(count(*) AS BIGINT) AS cases, round(avg(hit), 9) AS recall FROM r GROUP BY GROUPING SETS ((k, scenario), (k))"""


@query(RECALL_SQL)
def recall_depth_sweep(spark, sf):
    a, _ = routes(spark, sf)
    cases = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.max("o_orderkey").alias("target"))
    cases = cases.withColumn("scenario", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    return metrics.recall_at(a, cases, [1, 3, 10]).withColumn("recall", F.round("recall", 9))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    out = metrics.latency_percentiles(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")])


@query("SELECT value AS p50 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events) WHERE place = n // 2")
def upper_median(spark, sf):
    return metrics.upper_median(table(spark, sf, "events"), "value")


@query("SELECT turn, CAST(count(*) AS BIGINT) AS n, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, round(stddev_pop(length(text)), 6) AS pstdev FROM conversations GROUP BY turn")
def turn_stats(spark, sf):
    c = table(spark, sf, "conversations").select("turn", F.length("text").alias("size"))
    out = metrics.turn_statistics(c, "turn", "size")
    return out.select("turn", "n", F.round("mean", 6).alias("mean"), "median", F.round("pstdev", 6).alias("pstdev"))


@query(
    f"""WITH {SESSION_SQL}, f AS (SELECT scenario_type AS config, sample_id % 5 AS fold, avg(reciprocal_rank) AS score FROM s GROUP BY 1, 2)
    SELECT config, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS pstdev, round(min(score), 6) AS worst, round(max(score), 6) AS best FROM f GROUP BY config"""
)
def fold_aggregate(spark, sf):
    f = outcomes(spark, sf).groupBy(F.col("scenario_type").alias("config"), (F.col("sample_id") % 5).alias("fold")).agg(F.avg("reciprocal_rank").alias("score"))
    return metrics.fold_summary(f, "config", "score").select("config", *[F.round(c, 6).alias(c) for c in ("mean", "pstdev", "worst", "best")])


@query(
    f"""WITH {SESSION_SQL}, j AS (SELECT s.hit AS h, s2.hit AS h2, s.best_rank AS r, s2.best_rank AS r2 FROM s JOIN s2 USING (sample_id))
    SELECT CAST(count(*) FILTER (WHERE h AND NOT h2) AS BIGINT) AS target_suppressed, CAST(count(*) FILTER (WHERE r2 < r) AS BIGINT) AS moved_up, CAST(count(*) FILTER (WHERE r2 > r) AS BIGINT) AS moved_down,
    CAST(count(*) FILTER (WHERE NOT (h AND NOT h2) AND (r IS NULL OR r2 IS NULL OR r = r2)) AS BIGINT) AS unchanged, round(avg(r - r2) FILTER (WHERE r2 < r), 6) AS average_rank_improvement, round(avg(r2 - r) FILTER (WHERE r2 > r), 6) AS average_rank_loss FROM j"""
)
def movement_counts(spark, sf):
    m = metrics.movement_counts(outcomes(spark, sf), outcomes(spark, sf, True))
    return m.select("target_suppressed", "moved_up", "moved_down", "unchanged", F.round("average_rank_improvement", 6).alias("average_rank_improvement"), F.round("average_rank_loss", 6).alias("average_rank_loss"))


@query(
    f"""WITH {SESSION_SQL}, j AS (SELECT s2.sample_id, s2.scenario_type, s.best_rank AS b, s2.best_rank AS a, s.first_hit_turn AS bt, s2.first_hit_turn AS at_, s.hit AS bh, s2.hit AS ah, s.reciprocal_rank AS br, s2.reciprocal_rank AS ar FROM s JOIN s2 USING (sample_id)),
    o AS (SELECT *, CASE WHEN ah <> bh THEN CASE WHEN ah THEN 1 ELSE -1 END WHEN ar <> br THEN CASE WHEN ar > br THEN 1 ELSE -1 END ELSE sign(coalesce(bt, 11) - coalesce(at_, 11)) END AS better FROM j)
    SELECT sample_id, scenario_type, CASE WHEN better > 0 THEN 'improved' WHEN better < 0 THEN 'worsened' ELSE 'unchanged' END AS outcome,
    CASE WHEN b IS NOT NULL AND a IS NULL THEN 'disappeared' WHEN b IS NULL AND a IS NOT NULL THEN 'improved' WHEN a < b THEN 'improved' WHEN a > b THEN 'worsened' ELSE 'unchanged' END AS rank_movement,
    b AS baseline_rank, a AS perturbed_rank, bt AS baseline_hit_turn, at_ AS perturbed_hit_turn FROM o"""
)
def robustness_deltas(spark, sf):
    return metrics.robustness_deltas(outcomes(spark, sf), outcomes(spark, sf, True))


@query(
    """SELECT 'click;error;purchase;signup;view' AS model_id, 'none' AS served_model_id, CAST(count(*) AS BIGINT) AS telemetry_records, CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens,
    round(quantile_cont(greatest(value, 0) * 1000, 0.5), 4) AS p50_ms, round(quantile_cont(greatest(value, 0) * 1000, 0.95), 4) AS p95_ms, CAST(sum(user_id) + sum(event_id) AS BIGINT) AS total_tokens, round((sum(user_id) + sum(event_id)) / CAST(100 AS DOUBLE), 4) AS tokens_per_session,
    round((sum(user_id) / 1e6 * 2.0 + sum(event_id) / 1e6 * 4.0) / 100, 6) AS cost_per_session FROM events"""
)
def telemetry_summary(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(F.col("event_type").alias("requested_model"), F.lit("").alias("served_model"), F.col("value").alias("latency_seconds"), F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("completion_tokens"), F.lit(0.0).alias("cost"))
    t = metrics.telemetry(r, 100, 2.0, 4.0)
    four = lambda c: F.round(c, 4).alias(c)
    return t.select("model_id", "served_model_id", "telemetry_records", "input_tokens", "output_tokens", four("p50_ms"), four("p95_ms"), "total_tokens", four("tokens_per_session"), F.round("cost_per_session", 6).alias("cost_per_session"))


@query(
    f"""WITH {ROUTES_SQL}, cfg AS (SELECT * FROM (VALUES ('shipped', CAST(0.35 AS DOUBLE), CAST(0.1 AS DOUBLE)), ('no_exact', 0.0, 0.1), ('no_bucket', 0.35, 0.0), ('bm25_only', 0.0, 0.0)) v(config, e, u)),
    p AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM a WHERE rank <= 500),
    s AS (SELECT config, p.query_id, p.doc_id, p.rank AS base_rank, CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 - (p.rank - 1) / CAST(n - 1 AS DOUBLE) END + CASE WHEN p.status = 'F' THEN e ELSE 0 END + CASE WHEN b.doc_id IS NOT NULL THEN u ELSE 0 END AS score
      FROM p CROSS JOIN cfg LEFT JOIN b ON p.query_id = b.query_id AND p.doc_id = b.doc_id AND b.rank <= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, base_rank) AS rank FROM s),
    t AS (SELECT query_id, max(doc_id) AS target FROM a GROUP BY query_id)
    SELECT config, round(avg(CAST(1.0 AS DOUBLE) / rank), 6) AS mrr FROM r JOIN t ON r.query_id = t.query_id AND r.doc_id = t.target GROUP BY config"""
)
def ablation_grid(spark, sf):
    """Fusion with and without each route, by the place of a target."""
    a, b = routes(spark, sf)
    target = a.groupBy("query_id").agg(F.max("doc_id").alias("doc_id"))
    out = None
    for config, exact, bucket in (("shipped", 0.35, 0.1), ("no_exact", 0.0, 0.1), ("no_bucket", 0.35, 0.0), ("bm25_only", 0.0, 0.0)):
        fused = fusion.fuse_pool(a, a.filter("status = 'F'"), b.filter("rank <= 3"), exact_boost=exact, bucket_boost=bucket)
        one = fused.join(target, ["query_id", "doc_id"]).agg(F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr")).select(F.lit(config).alias("config"), "mrr")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------- splits, graphs


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(o_orderpriority || chr(0) || o_orderkey)) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN place <= round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 'tune' ELSE 'holdout' END AS split FROM r"""
)
def sha_split(spark, sf):
    key = [F.col("o_orderpriority"), F.col("o_orderkey").cast("string")]
    return resample.hash_split(table(spark, sf, "orders"), 0.7, "o_orderpriority", key).select("o_orderkey", "split")


@query(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN place <= round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 'tune' ELSE 'holdout' END AS split FROM r"""
)
def stratified_split(spark, sf):
    return resample.ordered_split(table(spark, sf, "orders"), 0.7, "o_orderpriority", "o_orderkey").select("o_orderkey", "split")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def first_per_scenario(spark, sf):
    return resample.first_per_group(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query(
    """WITH RECURSIVE e AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 AND x.c_mktsegment = y.c_mktsegment),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT c_custkey, c_custkey FROM customer),
    w AS (SELECT a AS node, a AS reach FROM u UNION SELECT w.node, u.b FROM w JOIN u ON w.reach = u.a)
    SELECT node, min(reach) AS component FROM w GROUP BY node"""
)
def connected_components(spark, sf):
    """Customers next to each other in one market segment."""
    c = table(spark, sf, "customer")
    near = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_custkey").alias("b"), "c_mktsegment")
    e = c.join(near, ["c_custkey", "c_mktsegment"]).select(F.col("c_custkey").alias("a"), "b")
    return resample.connected_components(e, c.select(F.col("c_custkey").alias("node")))


@query(
    f"""WITH {SESSION_SQL}, o AS (SELECT s.sample_id AS idx, s.hit AS hit_a, s.reciprocal_rank AS rr_a, s.first_hit_turn AS turn_a, s2.hit AS hit_b, s2.reciprocal_rank AS rr_b, s2.first_hit_turn AS turn_b FROM s JOIN s2 USING (sample_id)),
    c AS (SELECT count(*) AS n FROM orders),
    i AS (SELECT n, unnest(range(0, n)) AS d FROM c), t AS (SELECT n, d, unnest(range(0, 10000)) AS b FROM i),
    l AS (SELECT b, ((x * 1103515245 + 12345) % 2147483648) // 65536 % n AS idx FROM (SELECT b, n, (((b * n + d + 20260831) % 2147483648) * 1103515245 + 12345) % 2147483648 AS x FROM t)),
    g AS (SELECT b, 0.5 * (avg(CASE WHEN hit_a THEN 1.0 ELSE 0 END) - avg(CASE WHEN hit_b THEN 1.0 ELSE 0 END)) + 0.3 * (avg(rr_a) - avg(rr_b))
      + 0.2 * (greatest(0.0, least(1.0, (11.0 - avg(coalesce(turn_a, 11))) / 10.0)) - greatest(0.0, least(1.0, (11.0 - avg(coalesce(turn_b, 11))) / 10.0))) AS delta FROM l JOIN o USING (idx) GROUP BY b)
    SELECT round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS se, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high,
    quantile_cont(delta, 0.025) > 0 OR quantile_cont(delta, 0.975) < 0 AS excludes_zero FROM g"""
)
def paired_bootstrap_lcg(spark, sf):
    one, two = outcomes(spark, sf), outcomes(spark, sf, True)
    pick = lambda d, p: d.select(F.col("sample_id").alias("idx"), F.col("hit").alias(f"hit_{p}"), F.col("reciprocal_rank").alias(f"rr_{p}"), F.col("first_hit_turn").alias(f"turn_{p}"))
    both = pick(one, "a").join(pick(two, "b"), "idx")
    out = resample.bootstrap_interval(resample.paired_bootstrap(both, 10_000, 20260831, one.count()))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "se", "low", "high")], "excludes_zero")


@query()
def fold_allocation(spark, sf):
    """Suppliers as sessions; neighbours in one nation are kept together."""
    names = F.array(*[F.lit(x) for x in resample.SCENARIOS])
    t = table(spark, sf, "supplier")
    s = t.select(F.col("s_suppkey").cast("string").alias("sample_id"), F.get(names, (F.col("s_nationkey") % 4).cast("int")).alias("scenario_type"))
    near = t.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("b"), "s_nationkey")
    e = t.join(near, ["s_suppkey", "s_nationkey"]).select(F.col("s_suppkey").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    manifest = resample.fold_manifest(s, e)
    resample.validate_manifest(s, manifest)
    return spark.createDataFrame([(f["name"], i) for f in manifest["folds"] for i in f["validation_sample_ids"]], "fold string, sample_id string")


# -------------------------------------------------------- state, streaming


@query(
    """WITH c AS (SELECT p_partkey, p_brand || '  quality' AS f, p_size, p_brand, p_retailprice, regexp_extract(p_name, '(?i)\\b(black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange)\\b', 1) AS color FROM part),
    l AS (SELECT p_partkey, list_filter([replace(f, '  ', ' '), CASE WHEN color <> '' THEN 'color: ' || lower(color) ELSE '' END, 'Size: ' || p_size, 'Brand: ' || p_brand], lambda x: x <> '') AS l FROM c)
    SELECT p_partkey, array_to_string(l[1:2], '|') AS hard, array_to_string(l[3:4], '|') AS soft FROM l"""
)
def intent_card(spark, sf):
    p = products(spark, sf)
    text = simulate.searchable_text(*[F.col(c) for c in ("title", "features", "details", "description", "categories", "store")])
    card = simulate.intent_card(F.col("title"), F.col("features"), F.col("details"), text, F.lit(None).cast("double"))
    out = p.select(F.col("ord").alias("p_partkey"), card.alias("card"))
    return out.select("p_partkey", F.array_join("card.hard_constraints", "|").alias("hard"), F.array_join("card.soft_preferences", "|").alias("soft"))


@query(
    f"""WITH c AS (SELECT p_partkey, ['Size: ' || p_size, p_name, 'Brand: ' || p_brand, 'cotton'] AS l, CASE p_partkey % 3 WHEN 0 THEN 'other' WHEN 1 THEN 'size' ELSE 'material' END AS attribute FROM part),
    m AS (SELECT p_partkey, attribute, list_filter(l, lambda v: v <> 'cotton' OR p_partkey % 2 = 0) AS l FROM c),
    f AS (SELECT p_partkey, attribute, CASE attribute WHEN 'other' THEN l WHEN 'size' THEN list_filter(l, lambda v: {CLASSIFY_SQL.replace('low', 'lower(v)')} = 'size') ELSE list_filter(l, lambda v: {CLASSIFY_SQL.replace('low', 'lower(v)')} = 'material') END AS x FROM m)
    SELECT p_partkey, CASE WHEN len(x) = 0 THEN 'I don''t have an additional preference for ' || attribute || '.' ELSE 'For that, what matters is: ' || array_to_string(x[1:2], '; ') || '.' END AS reply FROM f"""
)
def customer_reply_step(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    card = F.struct(F.array(F.concat(F.lit("Size: "), F.col("p_size").cast("string")), "p_name").alias("hard_constraints"), F.array(F.concat(F.lit("Brand: "), "p_brand"), F.lit("cotton")).alias("soft_preferences"))
    attribute = F.when(k % 3 == 0, "other").when(k % 3 == 1, "size").otherwise("material")
    told = F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("cotton")))
    rows = p.select("p_partkey", card.alias("card"), attribute.alias("attribute"), told.alias("told"))
    rows = rows.withColumn("matches", simulate.reply_matches(F.col("card"), F.col("attribute"), F.col("told")))
    return rows.select("p_partkey", simulate.customer_reply(F.lit("buying"), F.col("attribute"), F.col("matches"), F.lit(True)).alias("reply"))


def _talk(spark, sf) -> DataFrame:
    """Conversations of three turns, made of part: an opening, an answer, a change of mind."""
    p = table(spark, sf, "part")
    says = F.array(
        F.concat(F.lit("I'm looking for "), "p_name", F.lit(". Brand: "), "p_brand"),
        F.concat(F.lit("For that, what matters is: size: "), F.col("p_size").cast("string"), F.lit("; cotton.")),
        F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), "p_type", F.lit(" style.")),
    )
    return p.select(F.col("p_partkey").alias("session_id"), F.posexplode(says).alias("turn", "message")).withColumn("turn", F.col("turn") + 1)


@query(
    """SELECT p_partkey AS session_id, turn, 'intent_override' AS scenario, CASE turn WHEN 1 THEN 'Brand: ' || p_brand WHEN 2 THEN concat_ws('|', 'Brand: ' || p_brand, 'size: ' || p_size, 'cotton')
    ELSE concat_ws('|', 'size: ' || p_size, 'cotton', p_type || ' style') END AS active, CAST(CASE WHEN turn = 3 THEN 1 ELSE 0 END AS INTEGER) AS overrides
    FROM part CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS turn)"""
)
def slot_state_fold(spark, sf):
    s = dialog.fold_sessions(_talk(spark, sf))
    return s.select("session_id", "turn", "state.scenario", F.array_join("active", "|").alias("active"), F.col("state.override_count").alias("overrides"))


@query(
    """SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch,
    lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"""
)
def session_epochs(spark, sf):
    e = table(spark, sf, "events")
    rows = dialog.epochs(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select("user_id", "event_id", "epoch", F.lag("event_type").over(w).alias("before"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark, sf):
    out = streams.event_counts(table(spark, sf, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, CAST(count(*) AS BIGINT) AS events, min(ts) AS start FROM s GROUP BY user_id, n"""
)
def session_window_events(spark, sf):
    out = streams.event_sessions(table(spark, sf, "events"))
    return out.select("user_id", "events", F.col("start").cast("timestamp_ntz").alias("start"))


@query()
def eval_loop(spark, sf):
    """A simulated customer for each nation, replayed against the catalog; the metrics of the run."""
    from .plans.evaluate import Catalog, evaluate

    p = products(spark, sf)
    text = simulate.searchable_text(*[F.col(c) for c in ("title", "features", "details", "description", "categories", "store")])
    cards = p.select("ord", "doc_id", T.coarse_category(F.col("categories")).alias("category"), simulate.intent_card(F.col("title"), F.col("features"), F.col("details"), text, F.col("price")).alias("card"))
    names = F.array(*[F.lit(x) for x in resample.SCENARIOS])
    n = table(spark, sf, "nation").select("n_name", (F.col("n_nationkey") * 7).cast("long").alias("ord"), F.get(names, F.col("n_nationkey") % 4).alias("scenario_type"))
    samples = n.join(cards, "ord").select(F.col("n_name").alias("sample_id"), "scenario_type", F.col("doc_id").alias("target"), "category", "card")
    change = F.when(F.col("scenario_type") == "intent_override", simulate.override(F.col("card"), simulate.override_turn(F.col("sample_id"), F.col("scenario_type"))))
    samples = samples.withColumn("override", change)
    return metrics.session_metrics(evaluate(samples, Catalog.of(p)))
