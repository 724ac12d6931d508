"""The rule catalogue, search terms, prefilters and the static preview."""

from pyspark.sql import functions as F

from fleetbump.functions.patterns import has_call, is_useful_term
from fleetbump.operators import rules
from fleetbump.queries import standins as s
from fleetbump.queries.registry import query
from fleetbump.schemas import ACTION, CONDITIONS, NODE, RULES
from fleetbump.session import staged_path
from fleetbump.sources import landed, sinks


def _catalogue(spark, sf):
    """One rule set per part, every tenth broken in some way; ids repeat, so later ones replace earlier."""
    key = F.col("p_partkey")
    part = s.table(spark, sf, "part")
    condition = F.struct(
        F.when(key % 10 != 1, F.lit("greater_than")).alias("type"),
        F.when(key % 10 == 2, F.lit("one.two")).otherwise(F.concat(s.text("p_size"), F.lit(".0"))).alias("version"),
        F.lit(None).cast("string").alias("max_version"),
    )
    node = F.from_json(
        F.to_json(
            F.struct(
                F.lit("InvocationExpression").alias("type"),
                F.concat(F.lit("Do"), F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("method_name"),
                F.when(key % 3 == 0, F.col("p_name")).alias("containing_type"),
            )
        ),
        NODE,
    )
    action = F.from_json(
        F.when(key % 10 == 3, F.lit("{}")).otherwise(
            F.to_json(F.struct(F.lit("replace_invocation").alias("type"), F.col("p_brand").alias("replacement_method")))
        ),
        ACTION,
    )
    rule = F.struct(
        F.when(key % 10 == 4, F.lit("")).otherwise(F.concat(F.lit("Rule "), s.text("p_partkey"))).alias("name"),
        F.when(key % 10 == 5, F.array().cast(f"array<{NODE}>")).otherwise(F.array(node)).alias("target_nodes"),
        action.alias("action"),
    )
    return part.select(
        F.concat(F.lit("m"), (key % 1500).cast("string")).alias("id"),
        F.when(key % 10 == 6, F.lit("")).otherwise(F.col("p_name")).alias("package_name"),
        F.col("p_type").alias("description"),
        F.when(key % 10 == 7, F.array().cast(CONDITIONS)).otherwise(F.array(condition)).alias("version_conditions"),
        F.when(key % 10 == 8, F.array().cast(RULES)).otherwise(F.array(rule)).alias("rules"),
        key.cast("int").alias("ord"),
    )


s.SQL["catalogue"] = """
SELECT 'm' || (p_partkey % 1500) AS id, p_partkey AS ord, p_partkey % 10 AS kind, p_partkey % 3 = 0 AS typed,
       p_name, p_brand, p_type FROM part"""
s.SQL["kept_rules"] = """
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS n,
                                  min(ord) OVER (PARTITION BY id) AS place FROM catalogue) WHERE n = 1"""


@query("last_rule_definitions", "SELECT id, p_type AS description, place AS ord FROM kept_rules")
def last_rule_definitions(spark, sf):
    kept = rules.last_definitions(_catalogue(spark, sf))
    return kept.select("id", "description", F.col("ord").cast("bigint").alias("ord"))


@query(
    "rule_violations",
    """SELECT id, CAST(rule_ord AS BIGINT) AS rule_ord, problem FROM (
         SELECT id, -1 AS rule_ord, 'package_name is required' AS problem FROM kept_rules WHERE kind = 6
         UNION ALL SELECT id, -1, 'version_conditions is required' FROM kept_rules WHERE kind = 7
         UNION ALL SELECT id, -1, 'rules is required' FROM kept_rules WHERE kind = 8
         UNION ALL SELECT id, -1, 'condition lacks type or version' FROM kept_rules WHERE kind = 1
         UNION ALL SELECT id, -1, 'condition version is invalid' FROM kept_rules WHERE kind = 2
         UNION ALL SELECT id, 0, 'name is required' FROM kept_rules WHERE kind = 4
         UNION ALL SELECT id, 0, 'target_nodes is required' FROM kept_rules WHERE kind = 5
         UNION ALL SELECT id, 0, 'action.type is required' FROM kept_rules WHERE kind = 3)""",
)
def rule_violations(spark, sf):
    found = rules.violations(rules.last_definitions(_catalogue(spark, sf)))
    return found.withColumn("rule_ord", F.col("rule_ord").cast("bigint"))


@query(
    "rule_nodes",
    """SELECT id AS migration_id, CASE WHEN kind = 4 THEN '' ELSE 'Rule ' || ord END AS rule_name,
              'Do' || replace(p_name, ' ', '') AS method_name FROM kept_rules WHERE kind NOT IN (5, 8)""",
)
def rule_nodes(spark, sf):
    nodes = rules.rule_nodes(rules.last_definitions(_catalogue(spark, sf)))
    return nodes.select("migration_id", "rule_name", F.col("node.method_name").alias("method_name"))


@query(
    "search_terms",
    """SELECT DISTINCT term FROM (
         SELECT 'Do' || replace(p_name, ' ', '') AS term FROM kept_rules WHERE kind NOT IN (5, 8)
         UNION ALL SELECT p_brand FROM kept_rules WHERE kind NOT IN (3, 5, 8)) WHERE length(term) >= 3""",
)
def search_terms(spark, sf):
    # Type names here hold a blank, so they are no useful terms.
    return rules.search_terms(rules.last_definitions(_catalogue(spark, sf))).select("term")


# Terms stand under keys of their own at several depths; quotes, line ends and blanks have to survive, or to be rejected.
@query(
    "rule_document_terms",
    """SELECT DISTINCT term FROM (
         SELECT unnest(['Do' || replace(p_name, ' ', ''), p_brand, 'Old.' || p_type, 'Acme.' || p_brand, 'T"' || p_size || 'x',
                        'arg' || p_size, 'Z' || p_brand, p_name]) AS term FROM part)
       WHERE length(term) >= 3 AND NOT contains(term, ' ')""",
)
def rule_document_terms(spark, sf):
    part = s.table(spark, sf, "part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    node = F.struct(
        F.lit("Whatever").alias("type"),
        F.concat(F.lit("Do"), name).alias("method_name"),
        F.struct(F.concat(F.lit("Acme."), F.col("p_brand")).alias("containing_namespace"), F.lit("no").alias("note")).alias("deeper"),
    )
    action = F.struct(
        F.col("p_brand").alias("replacement_method"),
        F.concat(F.lit("arg"), s.text("p_size")).alias("argument_name"),
        F.array(F.array(F.struct(F.concat(F.lit('T"'), s.text("p_size"), F.lit("x")).alias("new_type")))).alias("lists"),
        F.concat(F.lit("Z"), "p_brand").alias("type_name"),
        F.lit('"old_type": "inside a text"').alias("comment"),
    )
    body = F.struct(
        F.array(F.struct(F.array(node).alias("target_nodes"), action.alias("action"))).alias("rules"),
        F.concat(F.lit("Old."), "p_type").alias("old_namespace"),
        F.col("p_name").alias("namespace"),
    )
    documents = part.select(F.col("p_partkey").alias("ord"), F.to_json(body).alias("json"))
    return rules.terms_in_rules(documents).select("term")


@query(
    "useful_terms",
    r"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
        WHERE length(word) BETWEEN 3 AND 200 AND NOT contains(word, chr(10)) AND regexp_matches(word, '\pL')
        GROUP BY word""",
)
def useful_terms(spark, sf):
    words = s.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return words.filter(is_useful_term(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_WORDS = ["table", "class=", "http://", "tion", "</main>", "token = "]
_ANY = " OR ".join(f"contains({{c}}, '{w}')" for w in _WORDS)


def _pages(spark, sf):
    return s.table(spark, sf, "pages").select(
        F.lit("pages").alias("repo_id"), F.col("url").alias("path"), F.col("html").alias("content"), "page_id"
    )


@query("pages_with_terms", f"SELECT page_id FROM pages WHERE {_ANY.format(c='html')}")
def pages_with_terms(spark, sf):
    return rules.keep_files_with_terms(_pages(spark, sf), _WORDS).select("page_id")


@query(
    "documents_with_terms",
    "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'token') OR contains(text, 'http') OR contains(text, 'ation ')",
)
def documents_with_terms(spark, sf):
    files = s.table(spark, sf, "documents").withColumnRenamed("text", "content")
    return rules.keep_files_with_terms(files, ["token", "http", "ation "]).select("doc_id", "n_chars").orderBy("doc_id")


@query(
    "static_preview",
    """SELECT 'src/D' || doc_id || '.cs' AS path, doc_id % 3 < 2 AS has_call FROM documents
       WHERE doc_id % 3 < 2 OR contains(text, 'OldCall') OR contains(text, 'Scanner') OR contains(text, 'Renamed')
          OR contains(text, 'AddScan') OR contains(text, 'Never')""",
)
def static_preview(spark, sf):
    from fleetbump.queries.plan_queries import plan_files

    wanted = [r for m in s.MIGRATIONS for r in m["rules"]]
    return rules.affected_files(plan_files(spark, sf), wanted).select("path", "has_call")


@query(
    "potential_changes",
    """SELECT 'src/D' || doc_id || '.cs' AS path, 'potential_change' AS type,
              'File contains patterns that may be affected by migration rules' AS description,
              concat_ws(',', CASE WHEN kind = 0 OR contains(text, 'OldCall') THEN 'Remove OldCall' END,
                        CASE WHEN contains(text, 'Renamed') THEN 'Rename Renamed' END,
                        CASE WHEN kind = 1 OR contains(text, 'AddScan') OR contains(text, 'Scanner') THEN 'Drop isEnabled' END,
                        CASE WHEN contains(text, 'Never') THEN 'Never' END) AS rules
       FROM (SELECT *, doc_id % 3 AS kind FROM documents)
       WHERE kind < 2 OR contains(text, 'OldCall') OR contains(text, 'Scanner') OR contains(text, 'Renamed')
          OR contains(text, 'AddScan') OR contains(text, 'Never')""",
)
def potential_changes(spark, sf):
    from fleetbump.queries.plan_queries import plan_files

    wanted = [r for m in s.MIGRATIONS for r in m["rules"]]
    found = rules.potential_changes(plan_files(spark, sf), wanted)
    return found.select("path", "type", "description", F.array_join("rules", ",").alias("rules"))


@query(
    "pages_with_calls",
    r"""SELECT page_id, regexp_matches(html, '\bwindow\s*\(') OR regexp_matches(html, '\btrack\s*\(')
              OR regexp_matches(html, '\bget\s*\(') AS has_call FROM pages""",
)
def pages_with_calls(spark, sf):
    html = F.col("content")
    hit = has_call(html, "window") | has_call(html, "track") | has_call(html, "get")
    return _pages(spark, sf).select("page_id", hit.alias("has_call"))


def _hits(spark, sf):
    key = F.col("event_id")
    return s.table(spark, sf, "events").select(
        s.text("user_id").alias("repo_id"),
        F.lit("term").alias("term"),
        F.when(key % 3 == 0, F.concat(F.lit("src/"), F.col("event_type"), F.lit(".cs")))
        .when(key % 3 == 1, F.lit(""))
        .alias("path"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("lib/"), F.col("event_type"), F.lit(".cs"))).alias("filename"),
        key.alias("ord"),
    )


s.SQL["hits"] = """
SELECT repo_id, path, min(ord) AS ord FROM (
  SELECT CAST(user_id AS VARCHAR) AS repo_id, event_id AS ord,
         CASE WHEN event_id % 3 = 0 THEN 'src/' || event_type || '.cs' WHEN event_id % 5 = 0 THEN NULL
              ELSE 'lib/' || event_type || '.cs' END AS path FROM events) WHERE path IS NOT NULL GROUP BY repo_id, path"""


@query("distinct_search_hits", "SELECT repo_id, path, ord FROM hits")
def distinct_search_hits(spark, sf):
    return rules.distinct_hits(_hits(spark, sf)).select("repo_id", "path", "ord")


@query(
    "search_hits_among_candidates",
    """SELECT r.id AS repo_id, p.path FROM repos r, (SELECT 'src/click.cs' AS path UNION ALL SELECT 'lib/view.cs'
         UNION ALL SELECT 'lib/none.cs') p
       WHERE EXISTS (SELECT 1 FROM hits h WHERE h.repo_id = r.id AND h.path = p.path)""",
)
def search_hits_among_candidates(spark, sf):
    candidates = s.repos(spark, sf).select(
        F.col("id").alias("repo_id"),
        F.explode(F.array(F.lit("src/click.cs"), F.lit("lib/view.cs"), F.lit("lib/none.cs"))).alias("path"),
    )
    return rules.hits_among(candidates, rules.distinct_hits(_hits(spark, sf)))


@query(
    "search_hits_read",
    """SELECT repo_id, term, path, min(ord) AS ord FROM (
         SELECT CAST(user_id AS VARCHAR) AS repo_id, 'term' || (event_id % 4) AS term, event_id AS ord,
                CASE WHEN event_id % 3 = 0 THEN 'src/' || event_type || '.cs' WHEN event_id % 5 = 0 THEN NULL
                     ELSE 'lib/' || event_type || '.cs' END AS path FROM events) WHERE path IS NOT NULL GROUP BY ALL""",
)
def search_hits_read(spark, sf):
    """Hits of several terms, landed and read back."""
    path = staged_path(spark, "hits")
    landing = _hits(spark, sf).withColumn("term", F.concat(F.lit("term"), (F.col("ord") % 4).cast("string")))
    sinks.write_table(landing, path, "json")
    return rules.distinct_hits(landed.read_search_hits(spark, path)).select("repo_id", "term", "path", "ord")
