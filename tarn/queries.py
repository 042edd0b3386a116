"""Queries over the data tables, each with the SQL that gives the same rows: name -> (SPARQL, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import edge_queries
from tarn.plans.compiler import NAMESPACES, Options
from tarn.session import SparqlSession
from tarn.sources.graphs import COLUMNS, Dataset, TriplesGraph
from tarn.sources.tables import NS, data_graph

PREFIXES = {"ex": NS, "xsd": "http://www.w3.org/2001/XMLSchema#", "fn": NAMESPACES["functions"], "agg": NAMESPACES["aggregates"], "fts": NAMESPACES["search"], "hint": NAMESPACES["hint"]}
DAY = '"{}T00:00:00Z"^^xsd:dateTime'

FLAGSHIP = f"""
SELECT ?nname (ROUND(SUM(?price * (1 - ?disc))) AS ?revenue) WHERE {{
  ?l ex:l_order ?o ; ex:l_supplier ?s ; ex:l_extendedprice ?price ; ex:l_discount ?disc .
  ?o ex:o_customer ?c ; ex:o_orderdate ?d .
  ?c ex:c_nation ?n . ?s ex:s_nation ?n .
  ?n ex:n_name ?nname ; ex:n_region ?r . ?r ex:r_name "ASIA" .
  FILTER(?d >= {DAY.format("1992-01-01")} && ?d < {DAY.format("2030-01-01")})
}} GROUP BY ?nname ORDER BY DESC(?revenue)"""

Q: dict[str, tuple[str, str]] = {
    "flagship": (
        FLAGSHIP,
        """SELECT n_name AS nname, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1992-01-01' AND o_orderdate < TIMESTAMP '2030-01-01' GROUP BY n_name""",
    ),
    "bgp_star": ("SELECT ?k ?t ?p { ?o ex:o_orderkey ?k ; ex:o_totalprice ?t ; ex:o_orderpriority ?p FILTER(?t > 300000) }", "SELECT o_orderkey AS k, o_totalprice AS t, o_orderpriority AS p FROM orders WHERE o_totalprice > 300000"),
    "bgp_subject_iri": ("SELECT ?c ?m { ?c ex:c_mktsegment ?m ; ex:c_acctbal ?b FILTER(?b < 0) }", "SELECT 'urn:data:customer/' || c_custkey AS c, c_mktsegment AS m FROM customer WHERE c_acctbal < 0"),
    "bgp_fk_chain": ("SELECT ?name ?r { ?c ex:c_name ?name ; ex:c_nation/ex:n_region/ex:r_name ?r }", "SELECT c_name AS name, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "bgp_constant_iri": ("SELECT ?o ?t { ?o ex:o_customer <urn:data:customer/7> ; ex:o_totalprice ?t }", "SELECT 'urn:data:order/' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_custkey = 7"),
    "bgp_type": ("SELECT ?n { ?x a ex:Nation ; ex:n_name ?n }", "SELECT n_name AS n FROM nation"),
    "bgp_predicate_variable": (
        "SELECT ?p (COUNT(*) AS ?n) { ?x a ex:Supplier . ?x ?p ?o } GROUP BY ?p",
        """SELECT 'urn:data:' || p AS p, (SELECT count(*) FROM supplier) AS n FROM (VALUES ('s_suppkey'), ('s_name'), ('s_acctbal'), ('s_nation')) t(p)
        UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM supplier)""",
    ),
    "bgp_repeated_variable": ("SELECT ?k { ?x ex:n_nationkey ?k ; ex:n_region ?r . ?r ex:r_regionkey ?k }", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey = n_regionkey"),
    "filter_logic": ("SELECT ?k { ?p ex:p_partkey ?k ; ex:p_size ?s ; ex:p_retailprice ?r FILTER((?s < 10 || ?s > 40) && !(?r > 1500)) }", "SELECT p_partkey AS k FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT (p_retailprice > 1500)"),
    "filter_in": ("SELECT ?k { ?p ex:p_partkey ?k ; ex:p_size ?s FILTER(?s IN (1, 2, 3 + 4)) }", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 2, 7)"),
    "filter_notin": ("SELECT ?c { ?x ex:c_custkey ?c ; ex:c_mktsegment ?m FILTER(?m NOT IN ('BUILDING', 'MACHINERY')) }", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "filter_regex": ("SELECT ?k ?n { ?p ex:p_partkey ?k ; ex:p_name ?n FILTER REGEX(?n, 't$') FILTER REGEX(?n, 'RED', 'i') }", "SELECT p_partkey AS k, p_name AS n FROM part WHERE regexp_matches(p_name, 't$') AND regexp_matches(p_name, '(?i)red')"),
    "filter_date": (
        f"SELECT ?k {{ ?o ex:o_orderkey ?k ; ex:o_orderdate ?d FILTER(?d >= {DAY.format('1995-01-01')} && ?d < {DAY.format('1996-07-01')}) }}",
        "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'",
    ),
    "filter_bound": ("SELECT ?k { ?c ex:c_custkey ?k OPTIONAL { ?o ex:o_customer ?c ; ex:o_orderstatus 'P' } FILTER(!BOUND(?o)) }", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "str_fns": (
        """SELECT ?k (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) (SUBSTR(?n, 2, 3) AS ?s) (STRLEN(?n) AS ?len) (CONCAT(?n, '-', STR(?k)) AS ?c) (STRBEFORE(?n, '_') AS ?b) (STRAFTER(?n, '_') AS ?a)
        { ?x ex:n_nationkey ?k ; ex:n_name ?n FILTER(STRSTARTS(?n, 'N') && CONTAINS(?n, '1') && !STRENDS(?n, '0')) }""",
        """SELECT CAST(n_nationkey AS BIGINT) AS k, upper(n_name) AS u, lower(n_name) AS l, substr(n_name, 2, 3) AS s, length(n_name) AS len, n_name || '-' || n_nationkey AS c,
        split_part(n_name, '_', 1) AS b, CASE WHEN strpos(n_name, '_') > 0 THEN substr(n_name, strpos(n_name, '_') + 1) ELSE '' END AS a
        FROM nation WHERE starts_with(n_name, 'N') AND contains(n_name, '1') AND NOT ends_with(n_name, '0')""",
    ),
    "replace_all": ("SELECT ?k (REPLACE(?n, '[0-4]', 'x') AS ?r) { ?x ex:s_suppkey ?k ; ex:s_name ?n }", "SELECT s_suppkey AS k, regexp_replace(s_name, '[0-4]', 'x', 'g') AS r FROM supplier"),
    "encode_uri": ("SELECT ?k (ENCODE_FOR_URI(CONCAT(?n, ' ~*/é')) AS ?e) { ?x ex:n_nationkey ?k ; ex:n_name ?n }", "SELECT CAST(n_nationkey AS BIGINT) AS k, url_encode(n_name || ' ~*/é') AS e FROM nation"),
    "math_fns": (
        "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) { ?x ex:c_custkey ?k ; ex:c_acctbal ?b }",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r FROM customer",
    ),
    "arithmetic": ("SELECT ?k (?s * 2 + 1 AS ?i) (?s / 4 AS ?d) (-?s AS ?m) { ?p ex:p_partkey ?k ; ex:p_size ?s }", "SELECT p_partkey AS k, CAST(p_size * 2 + 1 AS BIGINT) AS i, p_size / 4 AS d, CAST(-p_size AS BIGINT) AS m FROM part"),
    "date_parts": (
        "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) { ?o ex:o_orderkey ?k ; ex:o_orderdate ?d }",
        "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders",
    ),
    "time_parts": ("SELECT ?k (HOURS(?t) AS ?h) (MINUTES(?t) AS ?m) (SECONDS(?t) AS ?s) { ?e ex:event_id ?k ; ex:ts ?t }", "SELECT event_id AS k, hour(ts) AS h, minute(ts) AS m, second(ts) AS s FROM events"),
    "hash_fns": ("SELECT ?k (MD5(?n) AS ?m) (SHA1(?n) AS ?s1) (SHA256(?n) AS ?s2) { ?x ex:c_custkey ?k ; ex:c_name ?n }", "SELECT c_custkey AS k, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer"),
    "term_tests": (
        "SELECT ?k (isIRI(?x) AS ?i) (isLiteral(?n) AS ?l) (isNumeric(?k) AS ?num) (isBlank(?x) AS ?b) (STR(?x) AS ?s) (LANG(?n) AS ?g) (sameTerm(?k, 3) AS ?t) { ?x ex:n_nationkey ?k ; ex:n_name ?n }",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, true AS i, true AS l, true AS num, false AS b, 'urn:data:nation/' || n_nationkey AS s, '' AS g, n_nationkey = 3 AS t FROM nation",
    ),
    "casts": ("SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:double(STR(?k)) AS ?d) { ?x ex:s_suppkey ?k ; ex:s_acctbal ?b }", "SELECT s_suppkey AS k, CAST(trunc(s_acctbal) AS BIGINT) AS i, CAST(s_suppkey AS VARCHAR) AS s, CAST(s_suppkey AS DOUBLE) AS d FROM supplier"),
    "ext_hyperbolic": (
        "SELECT ?k (ROUND(fn:cosh(?x) * 1000000) AS ?c) (ROUND(fn:tanh(?x) * 1000000) AS ?t) (ROUND(fn:toRadians(?b) * 1000) AS ?r) { ?p ex:p_partkey ?k ; ex:p_size ?x ; ex:p_retailprice ?b FILTER(?x < 8) }",
        "SELECT p_partkey AS k, floor(cosh(p_size) * 1000000 + 0.5) AS c, floor(tanh(p_size) * 1000000 + 0.5) AS t, floor(radians(p_retailprice) * 1000 + 0.5) AS r FROM part WHERE p_size < 8",
    ),
    "bind_if_coalesce": (
        "SELECT ?k ?g ?z { ?x ex:c_custkey ?k ; ex:c_acctbal ?b OPTIONAL { ?o ex:o_customer ?x ; ex:o_orderstatus 'P' ; ex:o_totalprice ?t FILTER(?t > 400000) } BIND(IF(?b < 0, 'debt', 'fine') AS ?g) BIND(COALESCE(?t, -1.0) AS ?z) }",
        """SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS g, coalesce(o_totalprice, -1) AS z
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000""",
    ),
    "strsplit_fanout": ("SELECT ?k ?w { ?p ex:p_partkey ?k ; ex:p_name ?n BIND(fn:strsplit(?n, ' ') AS ?w) }", "SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS w FROM part"),
    "optional_basic": ("SELECT ?k ?o { ?c ex:c_custkey ?k OPTIONAL { ?o ex:o_customer ?c ; ex:o_orderpriority '1-URGENT' } }", "SELECT c_custkey AS k, 'urn:data:order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'"),
    "optional_filter": (
        "SELECT ?k ?t { ?c ex:c_custkey ?k ; ex:c_acctbal ?b OPTIONAL { ?o ex:o_customer ?c ; ex:o_totalprice ?t FILTER(?t > 40 * ?b) } FILTER(?b > 5000) }",
        "SELECT c_custkey AS k, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal WHERE c_acctbal > 5000",
    ),
    "optional_then_join": (
        "SELECT ?k ?name { ?c ex:c_custkey ?k OPTIONAL { ?c ex:c_nation ?n . ?n ex:n_region ?r . ?r ex:r_name 'ASIA' } ?n ex:n_name ?name FILTER(?k < 5) }",
        """SELECT k, n.n_name AS name FROM (SELECT c_custkey AS k, x.n_nationkey AS nk FROM customer LEFT JOIN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') x
        ON c_nationkey = x.n_nationkey WHERE c_custkey < 5) t JOIN nation n ON t.nk = n.n_nationkey OR t.nk IS NULL""",
    ),
    "union_bag": ("SELECT ?n { { ?x ex:s_name ?n } UNION { ?x ex:c_name ?n } UNION { ?x ex:s_name ?n } }", "SELECT s_name AS n FROM supplier UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier"),
    "union_hetero": ("SELECT ?s ?c { { ?x ex:s_name ?s } UNION { ?x ex:c_name ?c } }", "SELECT s_name AS s, NULL AS c FROM supplier UNION ALL SELECT NULL, c_name FROM customer"),
    "minus_basic": ("SELECT ?k { ?c ex:c_custkey ?k MINUS { ?o ex:o_customer ?c ; ex:o_orderstatus 'F' } }", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "minus_disjoint": ("SELECT ?k { ?c ex:n_nationkey ?k MINUS { ?r ex:r_name ?z } }", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation"),
    "exists": ("SELECT ?k { ?c ex:c_custkey ?k ; ex:c_acctbal ?b FILTER EXISTS { ?o ex:o_customer ?c ; ex:o_totalprice ?t FILTER(?t > 45 * ?b) } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 45 * c_acctbal)"),
    "not_exists": ("SELECT ?k { ?s ex:s_suppkey ?k FILTER NOT EXISTS { ?l ex:l_supplier ?s ; ex:l_quantity 50 ; ex:l_linenumber 7 } }", "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7)"),
    "exists_compound": (
        "SELECT ?k { ?c ex:c_custkey ?k ; ex:c_acctbal ?b FILTER(?b < 0 || EXISTS { ?o ex:o_customer ?c ; ex:o_orderstatus 'P' }) }",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "values_join": ("SELECT ?k ?m { VALUES (?m ?q) { ('BUILDING' 1) ('MACHINERY' 2) } ?c ex:c_custkey ?k ; ex:c_mktsegment ?m }", "SELECT c_custkey AS k, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "values_undef": (
        "SELECT ?k ?q { ?x ex:n_nationkey ?k ; ex:n_name ?n VALUES (?n ?q) { ('NATION_1' 1) (UNDEF 2) } }",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(1 AS BIGINT) AS q FROM nation WHERE n_name = 'NATION_1' UNION ALL SELECT n_nationkey, 2 FROM nation",
    ),
    "agg_group": (
        "SELECT ?f ?s (COUNT(*) AS ?n) (ROUND(SUM(?q)) AS ?sum) (ROUND(AVG(?p) * 100) AS ?avg) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) { ?l ex:l_returnflag ?f ; ex:l_linestatus ?s ; ex:l_quantity ?q ; ex:l_extendedprice ?p } GROUP BY ?f ?s",
        """SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, floor(sum(l_quantity) + 0.5) AS sum, floor(avg(l_extendedprice) * 100 + 0.5) AS avg, min(l_quantity) AS lo, max(l_quantity) AS hi
        FROM lineitem GROUP BY ALL""",
    ),
    "agg_having": ("SELECT ?c (COUNT(?o) AS ?n) { ?o ex:o_customer ?c } GROUP BY ?c HAVING (COUNT(?o) > 14)", "SELECT 'urn:data:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14"),
    "agg_distinct": ("SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(?c) AS ?m) (SUM(DISTINCT ?z) AS ?s) { ?o ex:o_customer ?c . ?c ex:c_nation ?x . ?x ex:n_nationkey ?z }", "SELECT count(DISTINCT o_custkey) AS n, count(*) AS m, CAST(sum(DISTINCT c_nationkey) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey"),
    "agg_expr": ("SELECT ?f (COUNT(*) * 2 AS ?n) (MAX(?q * ?d) AS ?m) { ?l ex:l_returnflag ?f ; ex:l_quantity ?q ; ex:l_discount ?d } GROUP BY ?f", "SELECT l_returnflag AS f, count(*) * 2 AS n, max(l_quantity * l_discount) AS m FROM lineitem GROUP BY l_returnflag"),
    "agg_group_expr": ("SELECT ?y (COUNT(*) AS ?n) { ?o ex:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL"),
    "agg_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?s) { ?x ex:n_nationkey ?k FILTER(?k > 1000) }", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS s FROM nation WHERE n_nationkey > 1000"),
    "agg_group_concat": ("SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) { ?x ex:n_name ?n ; ex:n_region ?y . ?y ex:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "agg_minmax_text": ("SELECT ?r (MIN(?n) AS ?lo) (MAX(?n) AS ?hi) { ?x ex:n_name ?n ; ex:n_region ?r } GROUP BY ?r", "SELECT 'urn:data:region/' || n_regionkey AS r, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey"),
    "agg_ml": (
        "SELECT (ROUND(agg:accuracy(?q, ?t) * 1000000) AS ?acc) (ROUND(agg:mse(?q, ?t) * 1000000) AS ?mse) (ROUND(agg:rmse(?q, ?t) * 1000000) AS ?rmse) { ?d ex:quality ?q ; ex:toxic ?t }",
        "SELECT floor(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) * 1000000 + 0.5) AS acc, floor(avg((quality - toxic) * (quality - toxic)) * 1000000 + 0.5) AS mse, floor(sqrt(avg((quality - toxic) * (quality - toxic))) * 1000000 + 0.5) AS rmse FROM labels",
    ),
    "agg_gmean": ("SELECT ?r (ROUND(agg:gmean(?k) * 1000000) AS ?g) { ?x ex:n_nationkey ?k ; ex:n_region ?r } GROUP BY ?r", "SELECT 'urn:data:region/' || n_regionkey AS r, floor(pow(product(n_nationkey), 1.0 / count(*)) * 1000000 + 0.5) AS g FROM nation GROUP BY n_regionkey"),
    "subselect_topk": (
        "SELECT ?name ?n { { SELECT ?c (COUNT(*) AS ?n) { ?o ex:o_customer ?c } GROUP BY ?c HAVING (COUNT(*) >= 12) } ?c ex:c_name ?name }",
        "SELECT c_name AS name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12) JOIN customer ON o_custkey = c_custkey",
    ),
    "order_limit_offset": ("SELECT ?k ?t { ?o ex:o_orderkey ?k ; ex:o_totalprice ?t } ORDER BY DESC(?t) ?k OFFSET 5 LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "distinct": ("SELECT DISTINCT ?m ?r { ?c ex:c_mktsegment ?m ; ex:c_nation ?n . ?n ex:n_region ?r }", "SELECT DISTINCT c_mktsegment AS m, 'urn:data:region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "path_seq": ("SELECT ?s ?r { ?s ex:s_nation/ex:n_region ?r }", "SELECT 'urn:data:supplier/' || s_suppkey AS s, 'urn:data:region/' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "path_alt": ("SELECT ?x ?n { ?x (ex:c_nation|ex:s_nation) ?n }", "SELECT 'urn:data:customer/' || c_custkey AS x, 'urn:data:nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'urn:data:supplier/' || s_suppkey, 'urn:data:nation/' || s_nationkey FROM supplier"),
    "path_inverse": ("SELECT ?r ?s { ?r ^ex:n_region/^ex:s_nation ?s }", "SELECT 'urn:data:region/' || n_regionkey AS r, 'urn:data:supplier/' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "path_negated": (
        "SELECT ?x ?v { ?x a ex:Region . ?x !(ex:r_name|<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>) ?v }",
        """SELECT 'urn:data:region/' || r_regionkey AS x, '"' || r_regionkey || '"^^http://www.w3.org/2001/XMLSchema#integer' AS v FROM region""",
    ),
    "path_plus": (
        "SELECT ?x ?z { ?x (ex:s_nation|ex:n_region)+ ?z }",
        """WITH RECURSIVE e AS (SELECT 'urn:data:supplier/' || s_suppkey AS x, 'urn:data:nation/' || s_nationkey AS y FROM supplier UNION SELECT 'urn:data:nation/' || n_nationkey, 'urn:data:region/' || n_regionkey FROM nation),
        r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x, y AS z FROM r""",
    ),
    "path_star_bound": ("SELECT ?z { <urn:data:supplier/3> (ex:s_nation|ex:n_region)* ?z }", "SELECT 'urn:data:supplier/3' AS z UNION ALL SELECT 'urn:data:nation/' || s_nationkey FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT 'urn:data:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 3"),
    "path_optional_bound": ("SELECT ?z { <urn:data:nation/4> ex:n_region? ?z }", "SELECT 'urn:data:nation/4' AS z UNION ALL SELECT 'urn:data:region/' || n_regionkey FROM nation WHERE n_nationkey = 4"),
    "graph_named": ("SELECT ?n { GRAPH <urn:g:people> { ?x ex:c_name ?n ; ex:c_acctbal ?b FILTER(?b > 9000) } }", "SELECT c_name AS n FROM customer WHERE c_acctbal > 9000"),
    "graph_variable": ("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?x ex:n_name|ex:c_name ?v } } GROUP BY ?g", "SELECT 'urn:g:people' AS g, count(*) AS n FROM customer UNION ALL SELECT 'urn:g:places', count(*) FROM nation"),
    "from_union": ("SELECT ?n ?c FROM <urn:g:people> FROM <urn:g:places> { ?x ex:c_nation ?y ; ex:c_name ?c . ?y ex:n_name ?n FILTER(CONTAINS(?c, '77')) }", "SELECT '\"' || n_name || '\"' AS n, '\"' || c_name || '\"' AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(c_name, '77')"),
    "service": ("SELECT ?n ?r { ?x ex:n_name ?n ; ex:n_region ?y SERVICE <urn:g:places> { ?y ex:r_name ?r } }", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "service_silent": ("SELECT ?n { ?x ex:n_name ?n SERVICE SILENT <urn:g:nowhere> { ?x ex:other ?r } }", "SELECT n_name AS n FROM nation"),
    "construct": (
        "CONSTRUCT { ?n ex:within ?r . ?r ex:holds ?n } WHERE { ?x ex:n_name ?n0 ; ex:n_region ?r BIND(?x AS ?n) }",
        """SELECT 'urn:data:nation/' || n_nationkey AS s, 'urn:data:within' AS p, 'i' AS o_k, 'urn:data:region/' || n_regionkey AS o_v, '' AS o_dt, '' AS o_lang FROM nation
        UNION ALL SELECT 'urn:data:region/' || n_regionkey, 'urn:data:holds', 'i', 'urn:data:nation/' || n_nationkey, '', '' FROM nation""",
    ),
    "describe": (
        "DESCRIBE <urn:data:region/2>",
        """SELECT 'urn:data:region/2' AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'i' AS o_k, 'urn:data:Region' AS o_v, '' AS o_dt, '' AS o_lang
        UNION ALL SELECT 'urn:data:region/2', 'urn:data:r_regionkey', 'l', '2', 'http://www.w3.org/2001/XMLSchema#integer', ''
        UNION ALL SELECT 'urn:data:region/2', 'urn:data:r_name', 'l', r_name, 'http://www.w3.org/2001/XMLSchema#string', '' FROM region WHERE r_regionkey = 2""",
    ),
    "ask": ("ASK { ?x ex:c_acctbal ?b FILTER(?b > 9990) }", "SELECT count(*) > 0 AS answer FROM customer WHERE c_acctbal > 9990"),
    "join_hint": ("SELECT ?k ?m { hint:Group hint:HashJoin true . ?o ex:o_orderkey ?k ; ex:o_customer ?c . ?c ex:c_mktsegment ?m FILTER(?m = 'BUILDING') }", "SELECT o_orderkey AS k, c_mktsegment AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "fts_match": (
        "SELECT ?k ?score { ?p ex:p_partkey ?k . ?p ex:p_name ?n . ?n fts:search 'red i' ; fts:relevance ?score ; fts:matchAllTerms 'true' . }",
        """SELECT p_partkey AS k, round((len(list_filter(w, lambda x: contains(x, 'red'))) / len(w) + len(list_filter(w, lambda x: contains(x, 'i'))) / len(w)) / 2, 3) AS score
        FROM (SELECT p_partkey, string_split('"' || p_name || '"', ' ') AS w FROM part) WHERE list_bool_or(list_transform(w, lambda x: contains(x, 'red'))) AND list_bool_or(list_transform(w, lambda x: contains(x, 'i')))""",
    ),
    "fts_rank": (
        "SELECT ?n ?rank { ?x ex:n_name ?n . ?n fts:search 'NATION 1' ; fts:rank ?rank ; fts:maxRank 4 . }",
        """SELECT n_name AS n, row_number() OVER (ORDER BY score DESC, s) - 1 AS rank FROM (SELECT n_name, 'urn:data:nation/' || n_nationkey AS s, round((CASE WHEN contains(n_name, 'NATION') THEN 1.0 ELSE 0 END + CASE WHEN contains(n_name, '1') THEN 1.0 ELSE 0 END) / 2, 3) AS score FROM nation)
        WHERE score > 0 ORDER BY score DESC, s LIMIT 5""",
    ),
    "docs_by_source": ("SELECT ?s ?l (COUNT(*) AS ?n) (SUM(?c) AS ?chars) { ?d ex:source ?s ; ex:lang ?l ; ex:n_chars ?c } GROUP BY ?s ?l", "SELECT source AS s, lang AS l, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL"),
    "docs_labels_join": ("SELECT ?d ?s { ?d ex:source ?s ; ex:quality 0 ; ex:toxic 0 }", "SELECT 'urn:data:doc/' || doc_id AS d, source AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 0"),
}

#: Updates run on a triple table made of nations and regions; the graph is then read back.
PLACES = """SELECT 'urn:data:nation/' || n_nationkey AS s, 'urn:data:n_region' AS p, 'urn:data:region/' || n_regionkey AS o FROM nation"""
UPDATES: dict[str, tuple[str, str]] = {
    "update_insert": (
        "INSERT { ?r ex:holds ?n } WHERE { ?n ex:n_region ?r } ; INSERT DATA { ex:a ex:n_region ex:b }",
        f"SELECT s, p, o FROM ({PLACES}) UNION ALL SELECT o, 'urn:data:holds', s FROM ({PLACES}) UNION ALL SELECT 'urn:data:a', 'urn:data:n_region', 'urn:data:b'",
    ),
    "update_delete": ("DELETE { ?n ex:n_region ?r } WHERE { ?n ex:n_region ?r FILTER(?r = <urn:data:region/2>) }", f"SELECT s, p, o FROM ({PLACES}) WHERE o <> 'urn:data:region/2'"),
    "update_modify": (
        "DELETE { ?n ex:n_region ?r } INSERT { ?n ex:was_in ?r } WHERE { ?n ex:n_region ?r FILTER(?r IN (<urn:data:region/1>, <urn:data:region/3>)) }",
        f"SELECT s, CASE WHEN o IN ('urn:data:region/1', 'urn:data:region/3') THEN 'urn:data:was_in' ELSE p END AS p, o FROM ({PLACES})",
    ),
    "update_copy_move": ("COPY DEFAULT TO <urn:g:x> ; CLEAR DEFAULT ; MOVE <urn:g:x> TO DEFAULT ; DELETE WHERE { ?n ex:n_region <urn:data:region/0> }", f"SELECT s, p, o FROM ({PLACES}) WHERE o <> 'urn:data:region/0'"),
}


def dataset(spark: SparkSession, folder: str) -> Dataset:
    """The tables as the default graph, and two groups of them as named graphs."""
    named = {"urn:g:people": data_graph(spark, folder, ["customer", "supplier"]), "urn:g:places": data_graph(spark, folder, ["nation", "region"])}
    return Dataset(data_graph(spark, folder), named)


def runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: SparqlSession(dataset(spark, folder), PREFIXES, Options()).query(text)


def update_runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        places = data_graph(spark, folder, ["nation"]).triples().where(F.col("p") == NS + "n_region").select(*COLUMNS)
        s = SparqlSession(TriplesGraph(places), PREFIXES)
        s.update(text)
        return s.dataset.default.triples().select("s", "p", F.col("o_v").alias("o"))

    return run


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """One pattern evaluated once and read from the cache by the second half of the query."""
    s = SparqlSession(dataset(spark, folder), PREFIXES)
    s.use_cache()
    return s.query("SELECT ?n ?r { { ?x ex:n_name ?n ; ex:n_region ?y . ?y ex:r_name ?r } UNION { ?a ex:n_name ?n ; ex:n_region ?b . ?b ex:r_name ?r } }")


CACHED_SQL = "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES (1), (2)) t(k)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: runner(q) for n, (q, _) in Q.items()} | {n: update_runner(q) for n, (q, _) in UPDATES.items()} | {"bgp_cache": cached} | edge_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in (Q | UPDATES).items()} | {"bgp_cache": CACHED_SQL} | edge_queries.oracle_sql()
