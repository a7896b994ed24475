"""Queries on filings: names, sets, triage, manifests and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import names, triage as R
from tracefold.operators import manifest as M, sets as S, store as D, triage as T
from tracefold.plans import inputs as I
from tracefold.plans import query
from tracefold.sources.files import table

# --- names and sets ---


@query(f"WITH {I.SERVED_SQL}\nSELECT s.path, control_number, item_number, document_id FROM served s LEFT JOIN refs r ON r.path = s.path")
def parse_filename(spark: SparkSession, sf: str) -> DataFrame:
    return I.served(spark, sf).select("path", names.parse_filename(F.col("path")).alias("n")).select("path", "n.*")


_RANGED = "ranged AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat('Pages ', CAST(o_orderkey AS STRING), ' to ', CAST(o_orderkey + 99 AS STRING)) WHEN 1 THEN concat('page 1-', CAST(o_custkey AS STRING)) WHEN 2 THEN 'Volume 2' WHEN 3 THEN concat('Tariff PAGES  7 – ', CAST(o_custkey AS STRING)) END AS description FROM {orders})"


@query(f"WITH {_RANGED.format(orders='orders')}\n" + r"SELECT o_orderkey, CAST(nullif(regexp_extract(description, '(?i)pages?\s+([0-9]+)\s*(?:–|-|to)\s*([0-9]+)', 1), '') AS INT) AS first_page, CAST(nullif(regexp_extract(description, '(?i)pages?\s+([0-9]+)\s*(?:–|-|to)\s*([0-9]+)', 2), '') AS INT) AS last_page FROM ranged")
def page_range(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.sql(f"WITH {_RANGED} SELECT * FROM ranged", orders=table(spark, sf, "orders"))
    return d.select("o_orderkey", names.page_range(F.col("description")).alias("r")).select("o_orderkey", "r.*")


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    d = I.served(spark, sf).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), names.parse_filename(F.col("path")).alias("n"))
    return d.where("n.control_number IS NOT NULL").select("path", "filename", "n.*")


_SAID = "said AS (SELECT filename, CASE WHEN item_number % 4 = 0 THEN item_number END AS page_offset, CASE WHEN item_number % 6 = 0 THEN TRUE WHEN item_number % 6 = 1 THEN FALSE END AS retrieval_eligible, concat('about ', filename) AS description FROM {refs} WHERE item_number % 3 <> 1)"


@query(f"WITH {I.SERVED_SQL},\n{_SAID.format(refs='refs')}\nSELECT r.filename, control_number, item_number, document_id, coalesce(page_offset, 0) AS page_offset, coalesce(retrieval_eligible, FALSE) AS retrieval_eligible, description FROM refs r LEFT JOIN said s ON s.filename = r.filename WHERE control_number = '70001'")
def src_list(spark: SparkSession, sf: str) -> DataFrame:
    """Listed files of one control number with the manifest's word on them; offsets and retrieval fail closed."""
    refs = _refs(spark, sf).where("control_number = '70001'")
    said = spark.sql(f"WITH {_SAID} SELECT * FROM said", refs=_refs(spark, sf))
    return M.with_manifest(refs.drop("path"), said)


_RUNS = I.SERVED_SQL + """,
gaps AS (SELECT *, CASE WHEN CAST(document_id AS BIGINT) - lag(CAST(document_id AS BIGINT)) OVER (PARTITION BY control_number, item_number ORDER BY CAST(document_id AS BIGINT)) > 32 THEN 1 ELSE 0 END AS leap FROM refs),
runs AS (SELECT *, sum(leap) OVER (PARTITION BY control_number, item_number ORDER BY CAST(document_id AS BIGINT)) AS run FROM gaps),
named AS (SELECT *, control_number || '_' || item_number || CASE WHEN max(run) OVER (PARTITION BY control_number, item_number) > 0 THEN '_' || chr(CAST(97 + run AS INT)) ELSE '' END AS set_id FROM runs),
sets AS (SELECT *, CAST(row_number() OVER (PARTITION BY set_id ORDER BY CAST(document_id AS BIGINT)) - 1 AS INT) AS part_ordinal, CAST(count(*) OVER (PARTITION BY set_id) AS INT) AS n_parts FROM named),
labels AS (SELECT set_id, CASE WHEN count(*) = 1 THEN min(filename) ELSE any_value(control_number) || '_' || any_value(item_number) || ' [' || arg_min(document_id, part_ordinal) || '..' || arg_max(document_id, part_ordinal) || ']' END AS label, CAST(count(*) AS INT) AS n_parts, arg_min(filename, part_ordinal) AS first_part FROM sets GROUP BY set_id)"""


@query(f"WITH {_RUNS}\nSELECT filename, set_id, part_ordinal, n_parts FROM sets")
def doc_sets(spark: SparkSession, sf: str) -> DataFrame:
    return S.document_sets(_refs(spark, sf)).select("filename", "set_id", "part_ordinal", "n_parts")


@query(f"WITH {_RUNS}\nSELECT set_id, label, n_parts, first_part FROM labels")
def set_labels(spark: SparkSession, sf: str) -> DataFrame:
    return S.set_labels(S.document_sets(_refs(spark, sf)))


_MEASURED = "measured AS (SELECT filename AS document, CASE item_number % 3 WHEN 0 THEN 'refuse_numerics' ELSE 'exact_structure_reported' END AS verdict FROM {refs} WHERE item_number % 5 <> 2)"


@query(f"WITH {_RUNS},\n{_MEASURED.format(refs='refs')}\nSELECT set_id, label, first_part, n_parts, verdict FROM labels LEFT JOIN measured ON document = first_part")
def verdict_join(spark: SparkSession, sf: str) -> DataFrame:
    refs = _refs(spark, sf)
    measured = spark.sql(f"WITH {_MEASURED} SELECT * FROM measured", refs=refs)
    return S.join_verdicts(S.set_labels(S.document_sets(refs)), measured).select("set_id", "label", "first_part", "n_parts", "verdict")


_LISTING = "listing AS (SELECT CASE c_custkey % 5 WHEN 0 THEN concat('/n/70001_', CAST(c_custkey AS STRING), '/Exhibit ', CAST(c_nationkey AS STRING), '.docx') WHEN 1 THEN concat('/n/zip/70001_', CAST(c_custkey - 1 AS STRING), '_memo.pdf') WHEN 2 THEN concat('/n/70001_', CAST(c_custkey - 2 AS STRING), '_x/Model.xlsx') WHEN 3 THEN concat('/n/70001_', CAST(c_custkey - 3 AS STRING), '/~$lock.docx') ELSE concat('/n/70001_', CAST(c_custkey - 4 AS STRING), '/readme.txt') END AS path FROM {customer})"


@query(f"WITH {_LISTING.format(customer='customer')}," + r"""
items AS (SELECT '70001' AS control_number, CAST(c_custkey AS INT) AS item_number, concat('70001_', CAST(c_custkey AS VARCHAR)) AS k FROM customer),
files AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, string_split(path, '/')[:-2] AS folders, lower(regexp_extract(path, '\.([^.]*)$', 1)) AS suffix, regexp_extract(path, '(70001_[0-9]+)', 1) AS found FROM listing),
paired AS (SELECT control_number, item_number, path, name, CASE suffix WHEN 'docx' THEN 0 WHEN 'pdf' THEN 1 WHEN 'xlsx' THEN 2 ELSE 3 END AS rank FROM items JOIN files ON found = k WHERE suffix IN ('docx', 'pdf', 'xlsx', 'xlsm') AND NOT starts_with(name, '~$') AND (contains(name, k || '_') OR len(list_filter(folders, lambda f: f = k OR contains(f, k || '_'))) > 0))
SELECT control_number, item_number, path, CAST(row_number() OVER (PARTITION BY control_number, item_number ORDER BY rank, name, path) AS INT) AS place, row_number() OVER (PARTITION BY control_number, item_number ORDER BY rank, name, path) = 1 AS is_primary FROM paired""")
def pair_natives(spark: SparkSession, sf: str) -> DataFrame:
    listing = spark.sql(f"WITH {_LISTING} SELECT * FROM listing", customer=table(spark, sf, "customer"))
    items = table(spark, sf, "customer").select(F.lit("70001").alias("control_number"), F.col("c_custkey").cast("int").alias("item_number"))
    return S.pair_natives(listing, items)


# --- triage ---


def _normal_sql(text: str) -> str:
    out = rf"regexp_replace(regexp_replace({text}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    for wrong, right in R.REPAIRS:
        out = f"regexp_replace({out}, '(?i){wrong}', '{right}', 'g')"
    return out


_ORGANISATIONS = "[" + ", ".join(f"'{w}'" for w in R.ORGANISATION_WORDS) + "]"
_PERSON_SQL = rf"""people AS (SELECT *, list_filter(regexp_split_to_array(replace(replace(party, ',', ' '), '.', '. '), '\s+'), lambda t: t <> '') AS ws FROM filings),
persons AS (SELECT *, coalesce(len(ws) BETWEEN 2 AND 3 AND NOT list_has_any(list_transform(ws, lambda t: rtrim(upper(t), '.')), {_ORGANISATIONS}) AND len(list_filter(ws, lambda t: NOT regexp_matches(t, '^[A-Za-z][A-Za-z''\-]*\.?$'))) = 0, FALSE) AS is_person, {_normal_sql('description')} AS normal FROM people)"""
_WHEN = "\n".join(f"WHEN regexp_matches(normal, '(?i){p}') THEN {i}" for i, (p, _) in enumerate(R.RULES))
_RULE_ROWS = ", ".join(f"({i}, '{p}', '{r}')" for i, (p, r) in enumerate(R.RULES))
_TRIAGE_SQL = f"""WITH {I.FILINGS_SQL},
{_PERSON_SQL},
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) v(rule_no, pattern, why)),
fired AS (SELECT *, CASE WHEN upper(trim(item_type)) = 'CONF' THEN -2 WHEN is_person THEN -1 {_WHEN} END AS rule_no FROM persons),
judged AS (SELECT f.control_number, f.item_number, f.item_type, f.description, f.party, f.rule_no IS NULL AS include, CASE f.rule_no WHEN -2 THEN 'confidential' WHEN -1 THEN 'pii_risk' ELSE why END AS reason, CASE f.rule_no WHEN -2 THEN 'item_type=' || item_type WHEN -1 THEN 'filing_party=individual' ELSE pattern END AS matched_rule FROM fired f LEFT JOIN rules r ON r.rule_no = f.rule_no)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return T.triage(I.filings(spark, sf))


@query(f"WITH {I.FILINGS_SQL} SELECT item_number, {_normal_sql('description')} AS normal FROM filings")
def norm_desc(spark: SparkSession, sf: str) -> DataFrame:
    return I.filings(spark, sf).select("item_number", R.normalize_description(F.col("description")).alias("normal"))


@query(f"WITH {I.FILINGS_SQL},\n{_PERSON_SQL} SELECT item_number, party, is_person FROM persons")
def is_person(spark: SparkSession, sf: str) -> DataFrame:
    return I.filings(spark, sf).select("item_number", "party", R.looks_like_person(F.col("party")).alias("is_person"))


@query(_TRIAGE_SQL + " SELECT item_number, include, reason, matched_rule FROM judged")
def triage(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("item_number", "include", "reason", "matched_rule")


@query(_TRIAGE_SQL + ", domain AS (SELECT unnest(['included', 'confidential', 'pii_risk', 'procedural', 'non_text', 'out_of_scope']) AS outcome) SELECT outcome, count(j.include) AS n, count(j.include) * 100.0::DOUBLE / (SELECT count(*) FROM judged) AS share FROM domain LEFT JOIN judged j ON outcome = coalesce(reason, 'included') GROUP BY outcome")
def triage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.summarize(_judged(spark, sf))


_CHOSEN = "chosen AS (SELECT CAST(o_orderkey * 3 AS INT) AS item_number FROM {orders} WHERE o_orderkey % 7 = 0)"


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"WITH {_CHOSEN} SELECT * FROM chosen", orders=table(spark, sf, "orders"))


@query(f"{_TRIAGE_SQL},\n{_CHOSEN.format(orders='orders')} SELECT item_number, description, include, reason, NOT include AS would_drop FROM judged WHERE item_number IN (SELECT item_number FROM chosen)")
def curated(spark: SparkSession, sf: str) -> DataFrame:
    return T.curated(_judged(spark, sf), _chosen(spark, sf)).select("item_number", "description", "include", "reason", "would_drop")


@query(f"WITH {I.FILINGS_SQL},\n{_CHOSEN.format(orders='orders')} SELECT item_number FROM chosen WHERE item_number NOT IN (SELECT item_number FROM filings)")
def curated_absent(spark: SparkSession, sf: str) -> DataFrame:
    return T.absent(I.filings(spark, sf), _chosen(spark, sf))


@query(f"WITH {I.SERVED_SQL},\n{_CHOSEN.format(orders='orders')} SELECT DISTINCT item_number FROM refs WHERE item_number NOT IN (SELECT item_number FROM chosen)")
def curated_stray(spark: SparkSession, sf: str) -> DataFrame:
    return T.stray(_refs(spark, sf), _chosen(spark, sf))


@query(_TRIAGE_SQL + " SELECT item_number, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, party, description FROM judged JOIN orders ON o_orderkey = item_number WHERE include")
def src_export(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates that triage keeps, with the day they were filed."""
    days = table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("item_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"))
    return _judged(spark, sf).where("include").join(days, "item_number").select("item_number", "filing_date", "party", "description")


# --- manifests ---


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Nested items of the served files, with assertions on some of the items, sets and documents."""
    s = S.document_sets(_refs(spark, sf))
    odd = lambda n, m: F.col("item_number") % n == m
    doc = F.struct(F.col("filename"), F.col("document_id"), F.when(odd(4, 0), F.col("item_number")).cast("int").alias("page_offset"), F.when(F.col("part_ordinal") == 1, "own words").alias("selection_note"))
    sets = s.groupBy("control_number", "item_number", "set_id").agg(F.array_sort(F.collect_list(doc)).alias("documents"))
    a_set = F.struct("set_id", F.when(odd(3, 0), "operative").alias("status"), F.when(odd(3, 0), F.lit(True)).alias("retrieval_eligible"), F.when(odd(5, 1), F.concat(F.lit("set "), "set_id")).alias("selection_note"), "documents")
    return sets.groupBy("control_number", "item_number").agg(F.array_sort(F.collect_list(a_set)).alias("sets")).withColumn("selection_note", F.concat(F.lit("item "), F.col("item_number").cast("string")))


_FLAT = _RUNS + """,
flat AS (SELECT filename, control_number, item_number, set_id, CASE WHEN item_number % 3 = 0 THEN 'operative' END AS status, CASE WHEN item_number % 3 = 0 THEN TRUE END AS retrieval_eligible,
  coalesce(CASE WHEN part_ordinal = 1 THEN 'own words' END, CASE WHEN item_number % 5 = 1 THEN 'set ' || set_id END, 'item ' || item_number) AS selection_note, document_id, CASE WHEN item_number % 4 = 0 THEN item_number END AS page_offset FROM sets)"""


@query(f"WITH {_FLAT}\nSELECT * FROM flat")
def manifest_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """What a nested manifest says of each document: its own word, else its set's, else its item's."""
    return M.flatten(_items(spark, sf))


_PRIOR = "prior AS (SELECT DISTINCT set_id, CASE WHEN item_number % 4 = 1 THEN 'operative' END AS status, CASE WHEN item_number % 4 = 1 THEN TRUE END AS retrieval_eligible, CASE WHEN item_number % 4 = 2 THEN 'kept' END AS selection_note FROM sets WHERE item_number % 2 = 1 OR item_number % 4 = 2)"


def _prior_items(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier manifest, nested; some of its sets have no documents any more."""
    said = spark.sql(f"WITH {_PRIOR.replace('FROM sets', 'FROM {sets}').replace('DISTINCT set_id', 'DISTINCT item_number, set_id')} SELECT * FROM prior", sets=S.document_sets(_refs(spark, sf)))
    none = F.array().cast("array<struct<filename:string,page_offset:int,description:string>>")
    one = F.array(F.struct(F.concat("set_id", F.lit(".pdf")).alias("filename"), F.col("item_number").alias("page_offset"), F.lit(None).cast("string").alias("description")))
    s = F.struct("set_id", "status", "retrieval_eligible", "selection_note", F.when(F.col("item_number") % 4 == 2, none).otherwise(one).alias("documents"))
    return said.groupBy("item_number").agg(F.array_sort(F.collect_list(F.struct(F.col("set_id").alias("k"), s.alias("s")))).alias("x")).select("item_number", F.transform("x", lambda x: x["s"]).alias("sets"))


def _prior(spark: SparkSession, sf: str) -> DataFrame:
    return M.prior_sets(_prior_items(spark, sf))


@query(f"WITH {_RUNS},\n{_PRIOR}\nSELECT set_id, status, retrieval_eligible, selection_note FROM prior")
def manifest_prior(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier manifest asserts of each set, sets without documents included."""
    return _prior(spark, sf)


@query(f"WITH {_RUNS}\nSELECT filename, coalesce(CASE WHEN item_number % 4 = 0 THEN item_number END, 0) AS page_offset, 'fresh' AS description, item_number % 4 = 0 AS carried FROM sets")
def carry_over_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Regenerated documents keep the page offsets that people have put in."""
    fresh = _refs(spark, sf).select("filename", F.lit(0).alias("page_offset"), F.lit("fresh").alias("description"))
    return M.carry_over(fresh, M.prior_documents(_items(spark, sf)), "filename", M.KEPT_DOC_FIELDS)


@query(f"WITH {_RUNS},\n{_PRIOR},\nheld AS (SELECT * FROM sets WHERE item_number % 9 <> 0)\nSELECT (SELECT count(DISTINCT (control_number, item_number)) FROM sets) AS items, count(DISTINCT set_id) AS sets, count(*) AS documents, (SELECT count(DISTINCT (control_number, item_number)) FROM sets WHERE item_number % 9 = 0) AS awaiting, count(DISTINCT set_id) FILTER (n_parts > 1) AS multipart, (SELECT count(*) FROM prior WHERE coalesce(status, CAST(retrieval_eligible AS VARCHAR), selection_note) IS NOT NULL) AS carried FROM held")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a manifest of which every ninth item awaits its sets."""
    items = _items(spark, sf)
    return M.counts(items.withColumn("sets", F.when(F.col("item_number") % 9 != 0, F.col("sets"))), carry_over(spark, sf))


@query(f"WITH {_RUNS},\n{_PRIOR}\nSELECT f.set_id, coalesce(p.status, 'undetermined') AS status, p.retrieval_eligible, p.selection_note, coalesce(p.status, CAST(p.retrieval_eligible AS VARCHAR), p.selection_note) IS NOT NULL AS carried FROM (SELECT DISTINCT set_id FROM sets) f LEFT JOIN prior p ON p.set_id = f.set_id")
def carry_over(spark: SparkSession, sf: str) -> DataFrame:
    """Regenerated sets keep what people have asserted on them."""
    fresh = S.document_sets(_refs(spark, sf)).select("set_id").distinct()
    fresh = fresh.select("set_id", F.lit("undetermined").alias("status"), F.lit(None).cast("boolean").alias("retrieval_eligible"), F.lit(None).cast("string").alias("selection_note"))
    return M.carry_over(fresh, _prior(spark, sf), "set_id", M.KEPT_SET_FIELDS)


# --- ingest ---

_STORED = "stored AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat('old ', text) ELSE text END AS text, source FROM {documents} WHERE doc_id % 5 <> 0)"


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    digest = names.content_hash(F.col("text")).alias("sha256")
    stored = spark.sql(f"WITH {_STORED} SELECT * FROM stored", documents=table(spark, sf, "documents")).select("doc_id", digest)
    return D.change_actions(stored, table(spark, sf, "documents").select("doc_id", "source", digest), ("doc_id",))


_ACTS = f"WITH {_STORED.format(documents='documents')},\nacts AS (SELECT d.doc_id, d.source, sha256(d.text) AS sha256, CASE WHEN s.doc_id IS NULL THEN 'insert' WHEN sha256(s.text) = sha256(d.text) THEN 'unchanged' ELSE 'reextract' END AS action FROM documents d LEFT JOIN stored s ON s.doc_id = d.doc_id)"


@query(_ACTS + " SELECT doc_id, source, sha256, action FROM acts")
def ingest_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What re-ingest does with each document, decided on digests before any extraction."""
    return _actions(spark, sf).select("doc_id", "source", "sha256", "action")


_COUNTS = _ACTS + f", anchors AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(string_split(text, chr(10))) / {I.LINES_A_PAGE}.0) AS INT))) AS p FROM documents)\nSELECT (SELECT count(DISTINCT source) FROM documents) AS filings, (SELECT count(DISTINCT source || '/' || lang) FROM documents) AS sets, count(*) AS documents, count(*) FILTER (action <> 'unchanged') AS reextracted, count(*) FILTER (action = 'unchanged') AS unchanged, (SELECT count(*) FROM anchors a JOIN acts b ON a.doc_id = b.doc_id WHERE b.action <> 'unchanged') AS anchors FROM acts"


@query(_COUNTS)
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    acts = _actions(spark, sf)
    anchors = I.pages(spark, sf).join(acts.where("action != 'unchanged'").select("doc_id"), "doc_id", "left_semi")
    return D.ingest_counts(d.select("source").distinct(), d.select("source", "lang").distinct(), acts, anchors)


def _stored(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A store that lacks every fifth document and holds an old text of every ninth."""
    old = spark.sql(f"WITH {_STORED} SELECT * FROM stored", documents=table(spark, sf, "documents"))
    return {
        "dockets": table(spark, sf, "region").where("r_regionkey < 3").selectExpr("r_regionkey AS docket", "concat('kept ', r_name) AS title"),
        "documents": old.select("doc_id", F.concat(F.lit("old://"), "doc_id").alias("source_url"), names.content_hash(F.col("text")).alias("sha256")),
        "texts": old.select("doc_id", "text"),
        "anchors": old.select("doc_id", F.lit(1).alias("page_no"), F.lit("old").alias("anchor")),
    }


def _ingested(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    d = table(spark, sf, "documents")
    new = {
        "dockets": table(spark, sf, "region").selectExpr("r_regionkey AS docket", "r_name AS title"),
        "documents": d.select("doc_id", F.concat(F.lit("new://"), "doc_id").alias("source_url"), names.content_hash(F.col("text")).alias("sha256")),
        "texts": d.select("doc_id", "text"),
        "anchors": I.pages(spark, sf).select("doc_id", "page_no", F.lit("new").alias("anchor")),
    }
    return D.ingest(_stored(spark, sf), new)


@query("SELECT CAST(r_regionkey AS BIGINT) AS docket, CASE WHEN r_regionkey < 3 THEN 'kept ' || r_name ELSE r_name END AS title FROM region")
def insert_dockets(spark: SparkSession, sf: str) -> DataFrame:
    """Dockets are put in once and never changed."""
    return _ingested(spark, sf)["dockets"].select(F.col("docket").cast("bigint").alias("docket"), "title")


@query(_ACTS + " SELECT doc_id, CASE WHEN action = 'insert' THEN 'new://' || doc_id ELSE 'old://' || doc_id END AS source_url, sha256, action <> 'unchanged' AS changed FROM acts")
def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Digests are brought up to date, the first source stays, and what changed is told."""
    return _ingested(spark, sf)["documents"]


@query("SELECT doc_id, sha256(text) AS sha256, length(text) AS n FROM documents")
def upsert_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are written for changed documents only; then all are the new ones."""
    return _ingested(spark, sf)["texts"].select("doc_id", names.content_hash(F.col("text")).alias("sha256"), F.length("text").cast("bigint").alias("n"))


@query(_ACTS + f", news AS (SELECT doc_id, CAST(unnest(range(1, CAST(ceil(len(string_split(text, chr(10))) / {I.LINES_A_PAGE}.0) AS INT) + 1)) AS INT) AS page_no, 'new' AS anchor FROM documents) SELECT n.* FROM news n JOIN acts a ON a.doc_id = n.doc_id AND action <> 'unchanged' UNION ALL SELECT doc_id, CAST(1 AS INT), 'old' FROM acts WHERE action = 'unchanged'")
def replace_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Changed documents get new anchors in place of theirs, the others keep them."""
    return _ingested(spark, sf)["anchors"]


@query(_ACTS + " SELECT count(*) AS documents, count(*) FILTER (action <> 'unchanged') AS reextracted, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action <> 'unchanged') AS texts FROM acts")
def ingest_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest would write: its own tables, counted and not committed."""
    return D.dry_run(_ingested(spark, sf))


@query("WITH known AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderdate AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'old party' END AS party, 'T' || (o_orderkey % 4) AS item_type FROM orders WHERE o_orderkey % 4 <> 0), fresh AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS d, CASE WHEN o_orderkey % 5 = 0 THEN 'new party' END AS party, 'N' || (o_orderkey % 4) AS item_type FROM orders WHERE o_orderkey % 3 <> 1) SELECT coalesce(a.k, b.k) AS item_number, CASE WHEN a.k IS NULL THEN b.d ELSE coalesce(b.d, a.d) END AS filing_date, CASE WHEN a.k IS NULL THEN b.party ELSE coalesce(b.party, a.party) END AS filing_party, CASE WHEN a.k IS NULL THEN b.item_type ELSE a.item_type END AS item_type FROM known a FULL JOIN fresh b ON a.k = b.k")
def upsert_filings(spark: SparkSession, sf: str) -> DataFrame:
    """New dates and parties over stored ones, nulls keep them; the type is set on insert only."""
    o = table(spark, sf, "orders")
    known = o.where("o_orderkey % 4 != 0").selectExpr("o_orderkey AS item_number", "o_orderdate AS filing_date", "CASE WHEN o_orderkey % 3 = 0 THEN 'old party' END AS filing_party", "concat('T', o_orderkey % 4) AS item_type")
    fresh = o.where("o_orderkey % 3 != 1").selectExpr("o_orderkey AS item_number", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS filing_date", "CASE WHEN o_orderkey % 5 = 0 THEN 'new party' END AS filing_party", "concat('N', o_orderkey % 4) AS item_type")
    return D.upsert(known, fresh, ("item_number",), keep=("filing_date", "filing_party"), frozen=("item_type",))


@query("WITH known AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'operative' ELSE 'undetermined' END AS s, c_custkey % 3 = 0 AS r FROM customer WHERE c_custkey % 4 <> 0), fresh AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'superseded' END AS s, CASE WHEN c_custkey % 5 = 0 THEN FALSE END AS r FROM customer) SELECT coalesce(a.k, b.k) AS set_id, coalesce(b.s, a.s, 'undetermined') AS status, coalesce(b.r, a.r, FALSE) AS retrieval_eligible FROM known a FULL JOIN fresh b ON a.k = b.k")
def upsert_sets(spark: SparkSession, sf: str) -> DataFrame:
    """A silent manifest keeps a decision; the defaults hold on insert only."""
    c = table(spark, sf, "customer")
    known = c.where("c_custkey % 4 != 0").selectExpr("c_custkey AS set_id", "CASE WHEN c_custkey % 3 = 0 THEN 'operative' ELSE 'undetermined' END AS status", "c_custkey % 3 = 0 AS retrieval_eligible")
    fresh = c.selectExpr("c_custkey AS set_id", "CASE WHEN c_custkey % 5 = 0 THEN 'superseded' END AS status", "CASE WHEN c_custkey % 5 = 0 THEN false END AS retrieval_eligible")
    return D.upsert(known, fresh, ("set_id",), keep=("status", "retrieval_eligible"), defaults={"status": "undetermined", "retrieval_eligible": False})


@query("WITH s AS (SELECT c_custkey AS set_id, CASE c_custkey % 4 WHEN 0 THEN 'operative' WHEN 1 THEN 'undetermined' WHEN 2 THEN 'superseded' ELSE 'excluded' END AS status, c_acctbal > 0 AS retrieval_eligible FROM customer) SELECT set_id, CASE WHEN status NOT IN ('operative', 'superseded', 'undetermined') THEN 'unknown status' ELSE 'undetermined but retrievable' END AS problem FROM s WHERE status = 'excluded' OR (status = 'undetermined' AND retrieval_eligible)")
def policy_violations(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "customer").selectExpr("c_custkey AS set_id", "CASE c_custkey % 4 WHEN 0 THEN 'operative' WHEN 1 THEN 'undetermined' WHEN 2 THEN 'superseded' ELSE 'excluded' END AS status", "c_acctbal > 0 AS retrieval_eligible")
    return D.policy_violations(s)


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_content(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_content(table(spark, sf, "documents").select("doc_id", names.content_hash(F.col("text")).alias("sha256")))


@query("SELECT r_name AS docket, n_name AS party, count(DISTINCT c_custkey) AS filings, count(DISTINCT o_orderkey) AS documents, count(*) AS chunks, CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS cents FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def fk_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Keys followed all the way: docket, party, filing, document, chunk."""
    t = lambda n: table(spark, sf, n)
    j = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("r_name").alias("docket"), F.col("n_name").alias("party")).agg(F.countDistinct("c_custkey").alias("filings"), F.countDistinct("o_orderkey").alias("documents"), F.count("*").alias("chunks"), F.round(F.sum("l_extendedprice") * 100).cast("bigint").alias("cents"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose filing is missing, after every tenth filing was taken away."""
    parent = table(spark, sf, "customer").where("c_custkey % 10 != 0").select(F.col("c_custkey").alias("o_custkey"))
    return D.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), parent, "o_custkey").select("o_orderkey", "o_custkey")
