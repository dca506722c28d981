"""Text queries over documents, pages, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.functions import text as T
from quillon.operators import overlap as O

from .registry import query, table

ALNUM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
COLLAPSED = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("exact_dup_hash", f"SELECT sha256(lower({COLLAPSED.format('text')})) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(H.document_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("kgram_contamination", f"""
WITH b AS (SELECT item_id, string_split({ALNUM.format('text')}, ' ') AS w FROM benchmark),
g AS (SELECT item_id, unnest(CASE WHEN len(w) < 12 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' ')) END) AS gram FROM b),
d AS (SELECT doc_id, string_split({ALNUM.format('text')}, ' ') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 6)), lambda i: array_to_string(w[i : i + 7], ' '))) AS gram FROM d)
SELECT e.doc_id, g.item_id, count(DISTINCT g.gram) AS grams FROM e JOIN (SELECT DISTINCT item_id, gram FROM g) g USING (gram) GROUP BY e.doc_id, g.item_id""")
def kgram_contamination(spark, sf_dir):
    return O.shared_kgrams(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), 8)


@query("url_domains", r"SELECT page_id, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS domain FROM pages")
def url_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_domain(F.col("url")).alias("domain"))


DOMAIN = r"regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '')"


@query("domain_filter", f"SELECT page_id FROM pages WHERE ({DOMAIN} = 'example.com' OR ends_with({DOMAIN}, '.example.com')) AND NOT ({DOMAIN} = 'ththre.example.com' OR ends_with({DOMAIN}, '.ththre.example.com'))")
def domain_filter(spark, sf_dir):
    domain = T.url_domain(F.col("url"))
    return table(spark, sf_dir, "pages").where(T.in_domains(domain, ("example.com",)) & ~T.in_domains(domain, ("ththre.example.com",))).select("page_id")


@query("guideline_flag", f"SELECT page_id, ({DOMAIN} = 'example.net' OR ends_with({DOMAIN}, '.example.net')) OR contains(lower(html), 'notice') AS guideline FROM pages")
def guideline_flag(spark, sf_dir):
    flag = T.in_domains(T.url_domain(F.col("url")), ("example.net",)) | F.contains(F.lower("html"), F.lit("notice"))
    return table(spark, sf_dir, "pages").select("page_id", flag.alias("guideline"))


@query("sentence_units", f"SELECT doc_id, len({SENTENCES.format('text')}) AS n_sentences, coalesce(({SENTENCES.format('text')})[1], '') AS first FROM documents")
def sentence_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), T.first_sentence(F.col("text")).alias("first"))


@query("compressed_texts", f"SELECT doc_id, regexp_replace(substr(array_to_string(({SENTENCES.format(COLLAPSED.format('text'))})[1:2], ' '), 1, 420), '[ ,;:]+$', '') AS compressed FROM documents")
def compressed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compress(F.col("text")).alias("compressed"))


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("query_terms", f"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS w, unnest(range(len(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)))) AS n FROM benchmark),
f AS (SELECT item_id, w, min(n) AS n FROM w WHERE length(w) > 2 AND w NOT IN ({STOP}) GROUP BY item_id, w)
SELECT item_id, array_to_string(list(w ORDER BY n)[1:10], ' ') AS terms FROM f GROUP BY item_id""")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("section_roles", """
SELECT doc_id, CASE WHEN regexp_matches(lower(t), 'abstract|summary') THEN 'abstract' WHEN regexp_matches(lower(t), 'intro|background') THEN 'intro' WHEN regexp_matches(lower(t), 'method|material|procedure') THEN 'methods'
WHEN regexp_matches(lower(t), 'result|finding') THEN 'results' WHEN regexp_matches(lower(t), 'discuss') THEN 'discussion' WHEN regexp_matches(lower(t), 'conclu') THEN 'conclusion' ELSE 'raw' END AS role
FROM (SELECT doc_id, (['Abstract', 'Background', 'Materials', 'Findings', 'Discussion', 'Conclusions', 'Other'])[1 + doc_id % 7] AS t FROM documents)""")
def section_roles(spark, sf_dir):
    titles = F.array(*[F.lit(x) for x in ("Abstract", "Background", "Materials", "Findings", "Discussion", "Conclusions", "Other")])
    return table(spark, sf_dir, "documents").select("doc_id", T.section_role(F.element_at(titles, (F.col("doc_id") % 7 + 1).cast("int"))).alias("role"))


@query("blocked_sections", """
SELECT doc_id, source IN ('references', 'acknowledgements', 'funding') OR regexp_matches(lower(source || ' ' || coalesce(text, '')), 'reference|acknowledg|funding|conflict of interest|supplement|author contribution') AS blocked FROM documents""")
def blocked_sections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.blocked_section(F.col("source"), F.col("text")).alias("blocked"))


@query("minimum_length", f"SELECT doc_id FROM documents WHERE length({COLLAPSED.format('text')}) >= 80")
def minimum_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length(T.collapse(F.col("text"))) >= 80).select("doc_id")


@query("token_estimates", "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS ceil_tokens, CAST(floor((length(text) + 3) / 4.0) AS BIGINT) AS up_tokens, CAST(floor(length(text) / 4.0) AS BIGINT) AS down_tokens FROM documents")
def token_estimates(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(c).alias("ceil_tokens"), T.token_estimate(c, "up").alias("up_tokens"), T.token_estimate(c, "down").alias("down_tokens"))


@query("deterministic_ids", """
SELECT p_partkey, substr(sha256(lower(trim(p_name)) || ':' || lower(p_type)), 1, 16) AS entity_id,
substr(sha256(lower(trim(p_name)) || ':' || lower(p_type)), 1, 16) || ':' || p_brand || ':made_by' AS relation_id FROM part""")
def deterministic_ids(spark, sf_dir):
    e = H.entity_id(F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", e.alias("entity_id"), H.relation_id(e, F.col("p_brand"), F.lit("made_by")).alias("relation_id"))


@query("chunk_keys", "SELECT doc_id, CAST(doc_id AS VARCHAR) || '_ft' || substr(sha1(source || chr(10) || chr(10) || text), 1, 12) AS chunk_key FROM documents")
def chunk_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.chunk_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("chunk_key"))


@query("capitalised_phrases")
def capitalised_phrases(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.capitalised_phrases(F.col("text"))), "|").alias("phrases"))


@query("text_cleaning", r"""
SELECT conv_id, turn, md5(trim(replace(replace(regexp_replace(text || chr(10) || 'Answer Choices: A. x', '(?is)\s*answer choices:.*$', ''), '<s>', ''), '</s>', ''))) AS cleaned FROM conversations""")
def text_cleaning(spark, sf_dir):
    c = T.without_choices(F.concat(F.col("text"), F.lit("\nAnswer Choices: A. x")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.without_tokens(c, ("<s>", "</s>")).cast("binary")).alias("cleaned"))


@query("chromosome_names", r"""
WITH n AS (SELECT p_partkey, (['chromosome 7', 'Chr 12', 'X', 'chrY', '17q21.31', 'unknown', ' MT '])[1 + p_partkey % 7] AS t FROM part),
m AS (SELECT p_partkey, trim(lower(t)) AS low, regexp_extract(trim(lower(t)), '^(?:chromosome |chr ?)?([0-9]{1,2}|x|y|mt)(?:[pq][0-9.]*)?$', 1) AS name FROM n)
SELECT p_partkey, CASE WHEN name <> '' THEN 'chr' || upper(name) ELSE low END AS chromosome FROM m""")
def chromosome_names(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("chromosome 7", "Chr 12", "X", "chrY", "17q21.31", "unknown", " MT ")])
    return table(spark, sf_dir, "part").select("p_partkey", T.chromosome(F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("chromosome"))


@query("article_ids_from_urls", r"""
WITH u AS (SELECT page_id, (['https://pubmed.example.gov/', 'https://www.example.gov/pubmed/', 'https://x.example.org/s?term=', 'https://y.example.org/'])[1 + page_id % 4] || CAST(page_id AS VARCHAR) AS url FROM pages)
SELECT page_id, coalesce(nullif(regexp_extract(url, 'pubmed\.[a-z.]+/([0-9]+)', 1), ''), nullif(regexp_extract(url, '/pubmed/([0-9]+)', 1), ''), nullif(regexp_extract(url, '[?&](?:term|id)=([0-9]+)', 1), '')) AS article FROM u""")
def article_ids_from_urls(spark, sf_dir):
    heads = F.array(*[F.lit(x) for x in ("https://pubmed.example.gov/", "https://www.example.gov/pubmed/", "https://x.example.org/s?term=", "https://y.example.org/")])
    url = F.concat(F.element_at(heads, (F.col("page_id") % 4 + 1).cast("int")), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.article_id(url).alias("article"))


@query("multiset_overlap", r"""
WITH t AS (SELECT conv_id, turn, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM conversations WHERE turn < 2),
c AS (SELECT conv_id, turn, w, count(*) AS n FROM t WHERE w <> '' GROUP BY ALL)
SELECT a.conv_id, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn = 0 AND b.turn = 1 GROUP BY a.conv_id""")
def multiset_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    side = lambda turn: c.where(F.col("turn") == turn).select(F.col("conv_id").alias("id"), "text")
    return O.multiset_overlap(side(0), side(1)).withColumnRenamed("id", "conv_id")


@query("text_contains_gold", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def text_contains_gold(spark, sf_dir):
    return O.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("content_quantiles", """
SELECT lang, count(*) AS n, quantile_disc(n_chars, 0.25) AS p25, quantile_disc(n_chars, 0.5) AS median, quantile_disc(n_chars, 0.9) AS p90, max(n_chars) AS most FROM documents GROUP BY lang""")
def content_quantiles(spark, sf_dir):
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n_chars)").cast("long")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), disc(0.25).alias("p25"), disc(0.5).alias("median"), disc(0.9).alias("p90"), F.max("n_chars").alias("most"))


@query("option_rotation", "SELECT item_id, array_to_string(list_reverse(string_split(text, ' ')[1:4]), '|') AS reversed FROM benchmark")
def option_rotation(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.reverse(F.slice(F.split("text", " "), 1, 4)), "|").alias("reversed"))
