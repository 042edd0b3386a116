"""Queries of single operators and of their edge cases, each with the SQL that gives the same rows: name -> (SPARQL, SQL)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.own import own_function
from tarn.functions.terms import XSD, E
from tarn.operators import results
from tarn.operators.cache import BGPCache
from tarn.operators.lineage import shared_dir
from tarn.plans.compiler import Compiler, Options
from tarn.session import SparqlSession
from tarn.sources.graphs import COLUMNS, Dataset, TriplesGraph
from tarn.sources.rdf import read_rdf, write_ntriples
from tarn.sources.tables import NS, data_graph

Run = Callable[[SparkSession, str], DataFrame]

NATION = "?x ex:n_nationkey ?k ; ex:n_name ?n"
KEY = "CAST(n_nationkey AS BIGINT) AS k"
STEPS = "(ex:s_nation|ex:n_region)"


def constants(**expressions: str) -> str:
    """One row of values of expressions, by nation 1."""
    return f"SELECT {' '.join(f'({e} AS ?{n})' for n, e in expressions.items())} {{ ?x ex:n_nationkey 1 }}"


def row(**values: str) -> str:
    return "SELECT " + ", ".join(f"{v} AS {n}" for n, v in values.items())


def digests(name: str) -> str:
    """VALUES of a digest of each nation's name."""
    return ", ".join(f"('NATION_{k}', '{hashlib.new(name, f'NATION_{k}'.encode()).hexdigest()}')" for k in range(25))


MOMENT = '"2011-01-10T14:45:13.815{}"^^xsd:dateTime'
NOTHING = "CAST(NULL AS VARCHAR)"

Q: dict[str, tuple[str, str]] = {
    # patterns
    "blank_node_pattern": (
        "SELECT ?n { _:x ex:n_name ?n ; ex:n_region [ ex:r_name 'ASIA' ] }",
        "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "empty_pattern": ("SELECT (COUNT(*) AS ?n) (SUM(?none) AS ?s) { }", "SELECT CAST(1 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS s"),
    "empty_group_joined": ("SELECT ?n { { } ?x ex:r_name ?n { } }", "SELECT r_name AS n FROM region"),
    "cartesian": (
        "SELECT ?a ?b { ?x ex:r_name ?a . ?y ex:n_nationkey ?b FILTER(?b < 7) }",
        "SELECT r_name AS a, CAST(n_nationkey AS BIGINT) AS b FROM region CROSS JOIN nation WHERE n_nationkey < 7",
    ),
    "reduced": ("SELECT REDUCED ?r { ?x ex:n_region ?r }", "SELECT 'urn:data:region/' || n_regionkey AS r FROM nation"),
    "from_named": ("SELECT ?g ?n FROM NAMED <urn:g:places> { GRAPH ?g { ?x ex:r_name ?n } }", "SELECT 'urn:g:places' AS g, r_name AS n FROM region"),
    # operators and functions
    "compare_all": (
        "SELECT ?k { ?x ex:p_partkey ?k ; ex:p_size ?s ; ex:p_brand ?b ; ex:p_retailprice ?r FILTER(?s <= 10 && ?s != 7 && ?b != 'Brand#2' && ?r >= 900.5) }",
        "SELECT p_partkey AS k FROM part WHERE p_size <= 10 AND p_size <> 7 AND p_brand <> 'Brand#2' AND p_retailprice >= 900.5",
    ),
    "term_uris": (
        f"SELECT ?k (isURI(?x) AS ?a) (isURI(?n) AS ?b) (IRI(CONCAT('urn:x:', ?n)) AS ?c) (URI(STR(?x)) AS ?d) (isIRI(URI('urn:y')) AS ?e) {{ {NATION} }}",
        f"SELECT {KEY}, true AS a, false AS b, 'urn:x:' || n_name AS c, 'urn:data:nation/' || n_nationkey AS d, true AS e FROM nation",
    ),
    "term_bnodes": (
        f"SELECT ?k (isBlank(BNODE()) AS ?a) (isBlank(BNODE(?n)) AS ?b) (sameTerm(BNODE(?n), BNODE(?n)) AS ?c) {{ {NATION} }}",
        f"SELECT {KEY}, true AS a, true AS b, true AS c FROM nation",
    ),
    "term_datatypes": (
        "SELECT ?k (STR(DATATYPE(?k)) AS ?a) (STR(DATATYPE(?n)) AS ?b) (STR(DATATYPE(?d)) AS ?c) (STR(DATATYPE(?k < 3)) AS ?e) { ?x ex:c_custkey ?k ; ex:c_name ?n ; ex:c_acctbal ?d }",
        f"SELECT c_custkey AS k, '{XSD}integer' AS a, '{XSD}string' AS b, '{XSD}double' AS c, '{XSD}boolean' AS e FROM customer",
    ),
    "term_made": (
        f"""SELECT ?k (STRDT(STR(?k), xsd:integer) + 1 AS ?a) (STR(DATATYPE(STRDT(?n, <urn:t>))) AS ?b) (LANG(STRLANG(?n, 'EN')) AS ?c)
        (STR(DATATYPE(STRLANG(?n, 'de'))) AS ?d) {{ {NATION} }}""",
        f"SELECT {KEY}, CAST(n_nationkey + 1 AS DOUBLE) AS a, 'urn:t' AS b, 'en' AS c, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS d FROM nation",
    ),
    "langmatches": (
        f"""SELECT ?k (LANGMATCHES(LANG(STRLANG(?n, 'en-GB')), 'EN') AS ?a) (LANGMATCHES('fr', 'en') AS ?b) (LANGMATCHES(LANG(STRLANG(?n, 'de')), '*') AS ?c)
        (LANGMATCHES(LANG(?n), '*') AS ?d) {{ {NATION} }}""",
        f"SELECT {KEY}, true AS a, false AS b, true AS c, false AS d FROM nation",
    ),
    "uuids": (
        f"SELECT ?k (STRLEN(STR(UUID())) AS ?a) (isIRI(UUID()) AS ?b) (REGEX(STRUUID(), '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$') AS ?c) {{ {NATION} }}",
        f"SELECT {KEY}, CAST(45 AS BIGINT) AS a, true AS b, true AS c FROM nation",
    ),
    "rand_now": (
        f"SELECT ?k (RAND() < 1 && RAND() >= 0 AS ?a) (YEAR(NOW()) > 2020 AS ?b) (NOW() = NOW() AS ?c) {{ {NATION} }}",
        f"SELECT {KEY}, true AS a, true AS b, true AS c FROM nation",
    ),
    "time_zones": (
        constants(
            a=f"TZ({MOMENT.format('-05:00')})",
            b=f"TZ({MOMENT.format('Z')})",
            c=f"TZ({MOMENT.format('')})",
            d=f"STR(TIMEZONE({MOMENT.format('-05:30')}))",
            e=f"STR(TIMEZONE({MOMENT.format('Z')}))",
            f=f"STR(TIMEZONE({MOMENT.format('')}))",
        ),
        row(a="'-5'", b="'0'", c="''", d="'-PT5H30M'", e="'PT0S'", f=NOTHING),
    ),
    "hash_long": (
        f"SELECT ?n (SHA384(?n) AS ?a) (SHA512(?n) AS ?b) {{ {NATION} }}",
        f"SELECT n_name AS n, a.d AS a, b.d AS b FROM nation JOIN (VALUES {digests('sha384')}) a(n, d) ON a.n = n_name JOIN (VALUES {digests('sha512')}) b(n, d) ON b.n = n_name",
    ),
    "ext_ratios": (
        """SELECT ?k (ROUND(fn:sinh(?s) * 1000) AS ?a) (ROUND(fn:coth(?s) * 1000000) AS ?b) (ROUND(fn:sech(?s) * 1000000) AS ?c) (ROUND(fn:csch(?s) * 1000000) AS ?d)
        (ROUND(fn:toDegrees(?s) * 1000) AS ?e) { ?x ex:p_partkey ?k ; ex:p_size ?s FILTER(?s < 8) }""",
        """SELECT p_partkey AS k, floor(sinh(p_size) * 1000 + 0.5) AS a, floor(1 / tanh(p_size) * 1000000 + 0.5) AS b, floor(1 / cosh(p_size) * 1000000 + 0.5) AS c,
        floor(1 / sinh(p_size) * 1000000 + 0.5) AS d, floor(degrees(p_size) * 1000 + 0.5) AS e FROM part WHERE p_size < 8""",
    ),
    # edges of functions
    "substr_edges": (
        constants(a="SUBSTR('abc', 0, 2)", b="SUBSTR('abc', -1)", c="SUBSTR('abc', 2, 0)", d="SUBSTR('abc', 1.5, 1.4)", e="SUBSTR('abc', 9)", f="SUBSTR('abc', -5, 3)", g="SUBSTR('a😀b', 2, 1)"),
        row(a="'a'", b="'abc'", c="''", d="'b'", e="''", f="''", g="'😀'"),
    ),
    "round_edges": (
        constants(a="FLOOR(1e300)", b="CEIL(-1e300)", c="ROUND(1e30)", d="ROUND(-0.5)", e="CEIL(9007199254740993)", f="FLOOR(-7)", g="ROUND(0.49999999)"),
        row(a="1e300::DOUBLE", b="-1e300::DOUBLE", c="1e30::DOUBLE", d="0::DOUBLE", e="9007199254740993::BIGINT", f="(-7)::BIGINT", g="0::DOUBLE"),
    ),
    "regex_edges": (
        constants(a="REGEX('a', '(')", b="COALESCE(STR(REGEX('a', 'a', 'k')), 'error')", c="REGEX('A', 'a', IF(1 < 2, 'i', ''))", d="REGEX('a.c', 'a.c', 'q')", e="REGEX('abc', 'a.c', 'q')"),
        row(a="CAST(NULL AS BOOLEAN)", b="'error'", c="true", d="true", e="false"),
    ),
    "replace_edges": (
        constants(a="REPLACE('abc', 'b', '[$1]')", b="REPLACE('abc', '(b)', '[$1$2]')", c="REPLACE('abc', '(b)', '$12')", d="COALESCE(REPLACE('abc', 'b', '$x'), 'error')", e="REPLACE('abc', '(', 'x')"),
        row(a="'a[]c'", b="'a[b]c'", c="'ab2c'", d="'error'", e=NOTHING),
    ),
    "cast_edges": (
        constants(
            a="STR(xsd:dateTime('foo'))",
            b="STR(xsd:dateTime('2020-02-30T00:00:00Z'))",
            c="STR(xsd:dateTime('2020-02-29T23:59:59.5Z'))",
            d="xsd:integer('1.5')",
            e="xsd:boolean('yes')",
            f="xsd:boolean('1')",
            g="xsd:double('1e3')",
        ),
        row(a=NOTHING, b=NOTHING, c="'2020-02-29T23:59:59.5Z'", d="CAST(NULL AS BIGINT)", e="CAST(NULL AS BOOLEAN)", f="true", g="1000::DOUBLE"),
    ),
    # aggregates
    "agg_avg_nothing": (
        "SELECT (AVG(?k) AS ?a) (AVG(DISTINCT ?k) AS ?b) (MIN(?k) AS ?c) (COUNT(?k) AS ?d) { ?x ex:n_nationkey ?k FILTER(?k > 1000) }",
        "SELECT 0::DOUBLE AS a, 0::DOUBLE AS b, CAST(NULL AS BIGINT) AS c, 0::BIGINT AS d",
    ),
    "agg_sample": (
        "SELECT ?y (SAMPLE(?n) AS ?s) { ?x ex:n_region ?y . ?y ex:r_name ?n } GROUP BY ?y",
        "SELECT 'urn:data:region/' || r_regionkey AS y, r_name AS s FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
    ),
    "agg_retrieval": (
        """SELECT ?y (ROUND(agg:precision(?k, ?z) * 1000000) AS ?p) (ROUND(agg:recall(?z, ?k) * 1000000) AS ?r) (ROUND(agg:f1(?k, ?z) * 1000000) AS ?f)
        { ?x ex:n_nationkey ?k ; ex:n_region ?y . ?y ex:r_regionkey ?z } GROUP BY ?y""",
        """SELECT 'urn:data:region/' || z AS y, floor(hits / n * 1000000 + 0.5) AS p, floor(hits / n * 1000000 + 0.5) AS r, floor(2 * (hits / n) * (hits / n) / nullif(hits / n + hits / n, 0) * 1000000 + 0.5) AS f
        FROM (SELECT n_regionkey AS z, count(*) AS n, count(*) FILTER (n_nationkey = n_regionkey)::DOUBLE AS hits FROM nation GROUP BY 1)""",
    ),
    # joins on variables that may be unbound
    "optional_twice": (
        """SELECT ?k ?o ?p { ?c ex:c_custkey ?k OPTIONAL { ?o ex:o_customer ?c ; ex:o_orderstatus 'P' } OPTIONAL { ?o ex:o_customer ?c ; ex:o_orderpriority ?p } FILTER(?k < 300) }""",
        """WITH a AS (SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_custkey < 300)
        SELECT k, 'urn:data:order/' || coalesce(o, o_orderkey) AS o, o_orderpriority AS p FROM a LEFT JOIN orders ON o_custkey = k AND (o = o_orderkey OR o IS NULL)""",
    ),
    "optional_of_union": (
        """SELECT ?k ?m ?b { ?c ex:c_custkey ?k ; ex:c_mktsegment ?m OPTIONAL { { ?c ex:c_acctbal ?b FILTER(?b < 0) } UNION { ?z ex:n_nationkey 3 BIND('BUILDING' AS ?m) } } FILTER(?k < 300) }""",
        """SELECT c_custkey AS k, c_mktsegment AS m, b FROM customer LEFT JOIN (SELECT c_custkey AS ck, NULL AS cm, c_acctbal AS b FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT NULL, 'BUILDING', NULL) t ON (ck IS NULL OR ck = c_custkey) AND (cm IS NULL OR cm = c_mktsegment) WHERE c_custkey < 300""",
    ),
    "minus_after_optional": (
        """SELECT ?k ?o { ?c ex:c_custkey ?k OPTIONAL { ?o ex:o_customer ?c ; ex:o_orderstatus 'P' } MINUS { ?o ex:o_orderpriority '1-URGENT' } FILTER(?k < 300) }""",
        """SELECT c_custkey AS k, 'urn:data:order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
        WHERE c_custkey < 300 AND (o_orderpriority IS NULL OR o_orderpriority <> '1-URGENT')""",
    ),
    "exists_after_optional": (
        """SELECT ?k ?o { ?c ex:c_custkey ?k OPTIONAL { ?o ex:o_customer ?c ; ex:o_orderstatus 'P' } FILTER EXISTS { ?o ex:o_customer ?c ; ex:o_orderpriority '1-URGENT' } FILTER(?k < 300) }""",
        """SELECT k, 'urn:data:order/' || o AS o FROM (SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_custkey < 300)
        WHERE EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = k AND u.o_orderpriority = '1-URGENT' AND (o IS NULL OR o = u.o_orderkey))""",
    ),
    "not_exists_after_optional": (
        """SELECT ?k ?o { ?c ex:c_custkey ?k OPTIONAL { ?o ex:o_customer ?c ; ex:o_orderstatus 'P' } FILTER NOT EXISTS { ?o ex:o_customer ?c ; ex:o_orderpriority '1-URGENT' } FILTER(?k < 300) }""",
        """SELECT k, 'urn:data:order/' || o AS o FROM (SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_custkey < 300)
        WHERE NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = k AND u.o_orderpriority = '1-URGENT' AND (o IS NULL OR o = u.o_orderkey))""",
    ),
    "exists_twice": (
        "SELECT ?k { ?c ex:c_custkey ?k FILTER(EXISTS { ?o ex:o_customer ?c ; ex:o_orderstatus 'P' } || NOT EXISTS { ?u ex:o_customer ?c }) }",
        "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    # paths
    "path_to_known_end": (
        f"SELECT ?s {{ ?s {STEPS}+ <urn:data:region/2> }}",
        """SELECT 'urn:data:supplier/' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2
        UNION ALL SELECT 'urn:data:nation/' || n_nationkey FROM nation WHERE n_regionkey = 2""",
    ),
    "path_star_to_known_end": (
        f"SELECT ?s {{ ?s {STEPS}* <urn:data:region/2> }}",
        """SELECT 'urn:data:supplier/' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2
        UNION ALL SELECT 'urn:data:nation/' || n_nationkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'urn:data:region/2'""",
    ),
    "path_both_ends": (
        f"""SELECT ?a ?b ?c {{ {{ SELECT (COUNT(*) AS ?a) {{ <urn:data:nation/7> {STEPS}+ <urn:data:region/2> }} }} {{ SELECT (COUNT(*) AS ?b) {{ <urn:data:nation/7> {STEPS}* <urn:data:nation/7> }} }}
        {{ SELECT (COUNT(*) AS ?c) {{ <urn:data:nation/7> ex:n_region? <urn:data:region/99> }} }} }}""",
        "SELECT (SELECT count(*) FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2) AS a, 1::BIGINT AS b, 0::BIGINT AS c",
    ),
    "paths_joined": (
        "SELECT ?s { ?c ex:c_custkey 7 ; ex:c_nation/ex:n_region ?r . ?s ex:s_nation/ex:n_region ?r }",
        """SELECT 'urn:data:supplier/' || s_suppkey AS s FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey
        WHERE a.n_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7)""",
    ),
    "path_from_bound": (
        f"SELECT ?k ?z {{ ?x ex:s_suppkey ?k . ?x {STEPS}+ ?z FILTER(?k < 5) }}",
        """SELECT s_suppkey AS k, 'urn:data:nation/' || s_nationkey AS z FROM supplier WHERE s_suppkey < 5
        UNION ALL SELECT s_suppkey, 'urn:data:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey < 5""",
    ),
    "path_star_from_values": (
        f"SELECT ?x ?z {{ VALUES ?x {{ <urn:data:nation/3> <urn:data:nation/999> }} ?x {STEPS}* ?z }}",
        "SELECT 'urn:data:nation/3' AS x, 'urn:data:nation/3' AS z UNION ALL SELECT 'urn:data:nation/3', 'urn:data:region/' || n_regionkey FROM nation WHERE n_nationkey = 3",
    ),
    "path_star_free": (
        "SELECT (COUNT(*) AS ?n) { ?x ex:n_region* ?z . ?z a ex:Region }",
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n",
    ),
    # full-text search
    "fts_relevance_bounds": (
        "SELECT ?n ?s { ?x ex:n_name ?n . ?n fts:search 'NATION 1' ; fts:relevance ?s ; fts:minRelevance '0.4' ; fts:maxRelevance '0.9' }",
        "SELECT n_name AS n, 0.5::DOUBLE AS s FROM nation WHERE NOT contains(n_name, '1')",
    ),
    "fts_min_rank": (
        "SELECT ?n ?rank { ?x ex:n_name ?n . ?n fts:search 'NATION 1' ; fts:rank ?rank ; fts:minRank 3 ; fts:maxRank 8 }",
        """SELECT n_name AS n, rank FROM (SELECT n_name, row_number() OVER (ORDER BY CASE WHEN contains(n_name, '1') THEN 0 ELSE 1 END, 'urn:data:nation/' || n_nationkey) - 1 AS rank FROM nation)
        WHERE rank BETWEEN 3 AND 8""",
    ),
    # tables
    "pages_and_turns": (
        "SELECT ?r (COUNT(*) AS ?n) { ?t ex:conv_id ?c ; ex:role ?r ; ex:turn ?k . ?p ex:page_id ?c ; ex:url ?u } GROUP BY ?r",
        "SELECT role AS r, count(*) AS n FROM conversations JOIN pages ON page_id = conv_id GROUP BY role",
    ),
    "vector_labels": ("SELECT ?l (COUNT(?v) AS ?n) { ?v ex:label ?l } GROUP BY ?l", "SELECT CAST(label AS BIGINT) AS l, count(*) AS n FROM embeddings GROUP BY label"),
    # forms
    "ask_false": ("ASK { ?x ex:c_acctbal ?b FILTER(?b > 1e9) }", "SELECT false AS answer"),
    "construct_unbound": (
        "CONSTRUCT { ?c ex:has ?o . ?n ex:of ?c } WHERE { ?c ex:c_custkey ?k ; ex:c_name ?n OPTIONAL { ?o ex:o_customer ?c ; ex:o_orderstatus 'P' } FILTER(?k < 50) }",
        """SELECT 'urn:data:customer/' || o_custkey AS s, 'urn:data:has' AS p, 'i' AS o_k, 'urn:data:order/' || o_orderkey AS o_v, '' AS o_dt, '' AS o_lang
        FROM orders WHERE o_custkey < 50 AND o_orderstatus = 'P'""",
    ),
    "describe_found": (
        "DESCRIBE ?r { ?r ex:r_name 'ASIA' }",
        f"""SELECT 'urn:data:region/' || r_regionkey AS s, p, k AS o_k, v AS o_v, dt AS o_dt, '' AS o_lang FROM region, LATERAL (VALUES
        ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'i', 'urn:data:Region', ''), ('urn:data:r_regionkey', 'l', r_regionkey::VARCHAR, '{XSD}integer'), ('urn:data:r_name', 'l', r_name, '{XSD}string')) t(p, k, v, dt)
        WHERE r_name = 'ASIA'""",
    ),
}

#: Updates on a default graph of nations' regions and a named one of regions' names; both are then read back.
NATIONS = "SELECT '' AS g, 'urn:data:nation/' || n_nationkey AS s, 'urn:data:n_region' AS p, 'urn:data:region/' || n_regionkey AS o FROM nation"
REGIONS = "SELECT 'urn:g:r' AS g, 'urn:data:region/' || r_regionkey AS s, 'urn:data:r_name' AS p, r_name AS o FROM region"
BOTH = f"{NATIONS} UNION ALL {REGIONS}"


def one(g: str, s: str, p: str, o: str) -> str:
    return f"SELECT '{g}' AS g, 'urn:data:{s}' AS s, 'urn:data:{p}' AS p, 'urn:data:{o}' AS o"


UPDATES: dict[str, tuple[str, str]] = {
    "update_insert_data": ("INSERT DATA { ex:a ex:p ex:b . GRAPH <urn:g:r> { ex:c ex:p ex:d } }", f"{BOTH} UNION ALL {one('', 'a', 'p', 'b')} UNION ALL {one('urn:g:r', 'c', 'p', 'd')}"),
    "update_delete_data": ("INSERT DATA { ex:a ex:p ex:b , ex:c } ; DELETE DATA { ex:a ex:p ex:b . ex:no ex:p ex:no }", f"{BOTH} UNION ALL {one('', 'a', 'p', 'c')}"),
    "update_with": (
        "WITH <urn:g:r> DELETE { ?r ex:r_name ?n } INSERT { ?r ex:called ?n } WHERE { ?r ex:r_name ?n FILTER(?n != 'ASIA') }",
        f"{NATIONS} UNION ALL SELECT g, s, CASE WHEN o = 'ASIA' THEN p ELSE 'urn:data:called' END, o FROM ({REGIONS})",
    ),
    "update_using": ("INSERT { ?r ex:called ?n } USING <urn:g:r> WHERE { ?r ex:r_name ?n }", f"{BOTH} UNION ALL SELECT '', s, 'urn:data:called', o FROM ({REGIONS})"),
    "update_using_named": (
        "INSERT { ?r ex:called ?n } USING NAMED <urn:g:r> WHERE { GRAPH ?g { ?r ex:r_name ?n } }",
        f"{BOTH} UNION ALL SELECT '', s, 'urn:data:called', o FROM ({REGIONS})",
    ),
    "update_graph_templates": (
        "INSERT { GRAPH <urn:g:new> { ?r ex:holds ?n } } WHERE { ?n ex:n_region ?r } ; DELETE { GRAPH ?g { ?r ex:r_name ?n } } WHERE { GRAPH ?g { ?r ex:r_name ?n } }",
        f"{NATIONS} UNION ALL SELECT 'urn:g:new', o, 'urn:data:holds', s FROM ({NATIONS})",
    ),
    "update_create": (
        "CREATE GRAPH <urn:g:n> ; CREATE SILENT GRAPH <urn:g:r> ; INSERT DATA { GRAPH <urn:g:n> { ex:a ex:p ex:b } }",
        f"{BOTH} UNION ALL {one('urn:g:n', 'a', 'p', 'b')}",
    ),
    "update_drop_graph": ("DROP GRAPH <urn:g:r> ; DROP SILENT GRAPH <urn:g:none>", NATIONS),
    "update_drop_default": ("DROP DEFAULT", f"SELECT '' AS g, s, p, o FROM ({REGIONS})"),
    "update_drop_named": ("DROP NAMED", NATIONS),
    "update_drop_all": ("DROP ALL", NATIONS),
    "update_clear_graph": ("CLEAR GRAPH <urn:g:r>", NATIONS),
    "update_clear_all": ("CLEAR ALL", f"SELECT * FROM ({NATIONS}) WHERE false"),
    "update_add": ("ADD <urn:g:r> TO DEFAULT ; ADD SILENT <urn:g:none> TO DEFAULT", f"{BOTH} UNION ALL SELECT '', s, p, o FROM ({REGIONS})"),
    "update_copy": ("COPY <urn:g:r> TO <urn:g:x>", f"{BOTH} UNION ALL SELECT 'urn:g:x', s, p, o FROM ({REGIONS})"),
    "update_move": ("MOVE <urn:g:r> TO DEFAULT", f"SELECT '' AS g, s, p, o FROM ({REGIONS})"),
}


def plain_session(spark: SparkSession, folder: str, options: Options | None = None) -> SparqlSession:
    from tarn.queries import PREFIXES, dataset

    return SparqlSession(dataset(spark, folder), PREFIXES, options or Options())


def runner(text: str, **options) -> Run:
    return lambda spark, folder: plain_session(spark, folder, Options(**options)).query(text)


def small_graph(spark: SparkSession, folder: str, table: str, predicate: str) -> TriplesGraph:
    return TriplesGraph(data_graph(spark, folder, [table]).triples().where(F.col("p") == NS + predicate).select(*COLUMNS))


def update_session(spark: SparkSession, folder: str) -> SparqlSession:
    from tarn.queries import PREFIXES

    graphs = small_graph(spark, folder, "nation", "n_region"), small_graph(spark, folder, "region", "r_name")
    return SparqlSession(Dataset(graphs[0], {"urn:g:r": graphs[1]}), PREFIXES)


def every_triple(s: SparqlSession) -> DataFrame:
    """g (empty for the default graph), s, p and o of all graphs."""
    out = None
    for iri, graph in {"": s.dataset.default, **s.dataset.named}.items():
        part = graph.triples().select(F.lit(iri).alias("g"), "s", "p", F.col("o_v").alias("o"))
        out = part if out is None else out.unionByName(part)
    return out


def update_runner(text: str) -> Run:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        s = update_session(spark, folder)
        s.update(text)
        return every_triple(s)

    return run


def written_regions(spark: SparkSession, folder: str) -> str:
    """The named graph of regions as N-Triples in the shared folder."""
    path = f"{shared_dir(spark)}/tarn/regions-{uuid.uuid4().hex}.nt"
    write_ntriples(small_graph(spark, folder, "region", "r_name").triples(), path)
    return path


def update_load(spark: SparkSession, folder: str) -> DataFrame:
    s = update_session(spark, folder)
    s.update(f"LOAD <{written_regions(spark, folder)}> INTO GRAPH <urn:g:l> ; LOAD SILENT <{shared_dir(spark)}/none.nt>")
    return every_triple(s)


def ntriples_source(spark: SparkSession, folder: str) -> DataFrame:
    s = SparqlSession(TriplesGraph(read_rdf(spark, written_regions(spark, folder))), {"ex": NS})
    return s.query("SELECT ?r ?n { ?r ex:r_name ?n FILTER(?n != 'ASIA') }", native=False)


TURTLE = """@prefix : <urn:t:> . @base <urn:b/> .
:a :name "A"@en , 'say "B"' ; :size 5 ; :knows [ :name "inner" ] , <c> .
<c> a :Thing ; :list ( 1 2.5 true ) .
"""


def turtle_source(spark: SparkSession, folder: str) -> DataFrame:
    """Objects by predicate, blank nodes by their kind alone."""
    path = f"{shared_dir(spark)}/tarn/turtle-{uuid.uuid4().hex}.ttl"
    spark.createDataFrame([(TURTLE,)], "value string").coalesce(1).write.text(path)
    t = read_rdf(spark, path)
    return t.select("p", "o_k", F.when(F.col("o_k") != "b", F.col("o_v")).alias("v"), "o_dt", "o_lang")


RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TURTLE_ROWS = [
    ("urn:t:name", "l", "A", RDF + "langString", "en"),
    ("urn:t:name", "l", 'say "B"', XSD + "string", ""),
    ("urn:t:name", "l", "inner", XSD + "string", ""),
    ("urn:t:size", "l", "5", XSD + "integer", ""),
    ("urn:t:knows", "b", None, "", ""),
    ("urn:t:knows", "i", "urn:b/c", "", ""),
    (RDF + "type", "i", "urn:t:Thing", "", ""),
    ("urn:t:list", "b", None, "", ""),
    (RDF + "first", "l", "1", XSD + "integer", ""),
    (RDF + "first", "l", "2.5", XSD + "decimal", ""),
    (RDF + "first", "l", "true", XSD + "boolean", ""),
    (RDF + "rest", "b", None, "", ""),
    (RDF + "rest", "b", None, "", ""),
    (RDF + "rest", "i", RDF + "nil", "", ""),
]


def sql_rows(names: str, rows: list[tuple]) -> str:
    cell = lambda v: NOTHING if v is None else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def graph_factory(spark: SparkSession, folder: str) -> DataFrame:
    """Graphs urn:f:<table> are made when a query names them."""
    made = Dataset(data_graph(spark, folder, ["nation"]), factory=lambda iri: data_graph(spark, folder, [iri.rsplit(":", 1)[-1]]))
    return SparqlSession(made, {"ex": NS}).query("SELECT ?n ?r { ?x ex:n_name ?n ; ex:n_region ?y GRAPH <urn:f:region> { ?y ex:r_name ?r } }")


def analyzed(spark: SparkSession, folder: str) -> DataFrame:
    """Joins of a triple table in the order of its counts by predicate."""
    g = TriplesGraph(data_graph(spark, folder, ["nation", "region"]).triples())
    g.analyze()
    return SparqlSession(g, {"ex": NS}).query("SELECT ?n ?r { ?x ex:n_name ?n ; ex:n_region ?y . ?y ex:r_name ?r }", native=False)


def formatted(form: str) -> Run:
    """The rows of a result as text."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        s = plain_session(spark, folder)
        q = s.parse("SELECT ?x ?k ?n ?r { ?x ex:n_nationkey ?k ; ex:n_name ?n OPTIONAL { ?x ex:n_region ?r . ?r ex:r_name 'ASIA' } }")
        return results.rows(Compiler(s.dataset, s.options).solutions(q), form)

    return run


FORMATTED = "FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA'"
FORMS = {
    "json": f"""SELECT '{{"x":{{"type":"uri","value":"urn:data:nation/' || n_nationkey || '"}},"k":{{"type":"literal","value":"' || n_nationkey || '","datatype":"{XSD}integer"}},"n":{{"type":"literal","value":"' || n_name || '"}}'
        || CASE WHEN r_regionkey IS NULL THEN '' ELSE ',"r":{{"type":"uri","value":"urn:data:region/' || r_regionkey || '"}}' END || '}}' AS row {FORMATTED}""",
    "csv": f"SELECT 'urn:data:nation/' || n_nationkey || ',' || n_nationkey || ',' || n_name || ',' || coalesce('urn:data:region/' || r_regionkey, '') AS row {FORMATTED}",
    "tsv": f"""SELECT concat_ws(chr(9), '<urn:data:nation/' || n_nationkey || '>', '"' || n_nationkey || '"^^<{XSD}integer>', '"' || n_name || '"', coalesce('<urn:data:region/' || r_regionkey || '>', '')) AS row {FORMATTED}""",
    "xml": f"""SELECT '<result><binding name="x"><uri>urn:data:nation/' || n_nationkey || '</uri></binding><binding name="k"><literal datatype="{XSD}integer">' || n_nationkey || '</literal></binding><binding name="n"><literal>'
        || n_name || '</literal></binding>' || CASE WHEN r_regionkey IS NULL THEN '' ELSE '<binding name="r"><uri>urn:data:region/' || r_regionkey || '</uri></binding>' END || '</result>' AS row {FORMATTED}""",
}


def cache_part(spark: SparkSession, folder: str) -> DataFrame:
    """A larger pattern, of which a part was cached under other names, and a third one that drops the least recently used."""
    s = plain_session(spark, folder)
    cache = s.use_cache(BGPCache(capacity=2))
    s.query("SELECT * { ?a ex:n_region ?b . ?b ex:r_name ?c }").count()
    out = s.query("SELECT ?n ?r { ?x ex:n_region ?y . ?y ex:r_name ?r . ?x ex:n_name ?n }")
    s.query("SELECT * { ?a ex:s_name ?b }").count()
    return out.withColumn("entries", F.lit(len(cache)).cast("bigint"))


def outside_segment(element: list) -> list:
    """A rewrite rule: patterns of ex:segment become ones of ex:c_mktsegment."""
    rename = lambda t: ("iri", NS + "c_mktsegment") if t == ("iri", NS + "segment") else t
    return [(e[0], [tuple(rename(t) for t in p) for p in e[1]]) if e[0] == "triples" else e for e in element]


def twice(args: list[E]) -> E:
    return E(args[0].kind, args[0].col * 2)


def letters(args: list[E]) -> tuple[E, object]:
    """A generator: a solution for each letter."""
    return E("str", F.lit("")), F.split(args[0].col, "")


def capitals(text: str | None) -> str | None:
    """A term with capitals, for literals alone."""
    return text.upper() if text and text.startswith('"') else None


def signs(text: str) -> list[str]:
    """The first two signs of a literal, in English."""
    return [f'"{c}"@en' for c in text.strip('"')[:2]]


def failing(text: str) -> str:
    raise ValueError(text)


OWN_TERMS = {"urn:f:capitals": own_function(capitals), "urn:f:signs": own_function(signs, many=True), "urn:f:failing": own_function(failing)}
OWN_TERMS_QUERY = """SELECT ?k (STR(?u) AS ?a) ?i (LANG(?l) AS ?g) (STR(?l) AS ?c) ?b
{ ?x ex:n_nationkey ?k ; ex:n_name ?n BIND(<urn:f:capitals>(?n) AS ?u) BIND(<urn:f:capitals>(?x) AS ?i) BIND(<urn:f:signs>(?n) AS ?l) BIND(<urn:f:failing>(?n) AS ?b) }"""

REGION_ROWS = "SELECT 'urn:g:l' AS g, s, p, o FROM"
RUNS: dict[str, tuple[Run, str]] = {
    "update_load": (update_load, f"{BOTH} UNION ALL {REGION_ROWS} ({REGIONS})"),
    "source_ntriples": (ntriples_source, "SELECT 'urn:data:region/' || r_regionkey AS r, '\"' || r_name || '\"' AS n FROM region WHERE r_name <> 'ASIA'"),
    "source_turtle": (turtle_source, sql_rows("p, o_k, v, o_dt, o_lang", TURTLE_ROWS)),
    "graph_factory": (graph_factory, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "cardinality_order": (analyzed, "SELECT '\"' || n_name || '\"' AS n, '\"' || r_name || '\"' AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "cache_part": (cache_part, "SELECT n_name AS n, r_name AS r, 2::BIGINT AS entries FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "rewrite_rule": (runner("SELECT ?k { ?c ex:c_custkey ?k ; ex:segment 'BUILDING' }", rules=[outside_segment]), "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "own_functions": (
        runner("SELECT ?k ?d ?l { ?x ex:n_nationkey ?k ; ex:n_name ?n BIND(<urn:f:twice>(?k) AS ?d) BIND(<urn:f:letters>(SUBSTR(?n, 1, 2)) AS ?l) }", functions={"urn:f:twice": twice, "urn:f:letters": letters}),
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * 2 AS BIGINT) AS d, unnest(string_split(substr(n_name, 1, 2), '')) AS l FROM nation",
    ),
    "own_functions_of_terms": (
        runner(OWN_TERMS_QUERY, functions=OWN_TERMS),
        f"SELECT {KEY}, upper(n_name) AS a, {NOTHING} AS i, 'en' AS g, unnest(string_split(substr(n_name, 1, 2), '')) AS c, {NOTHING} AS b FROM nation",
    ),
    **{f"results_{form}": (formatted(form), sql) for form, sql in FORMS.items()},
}


def queries() -> dict[str, Run]:
    return {n: runner(q) for n, (q, _) in Q.items()} | {n: update_runner(q) for n, (q, _) in UPDATES.items()} | {n: r for n, (r, _) in RUNS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in (Q | UPDATES | RUNS).items()}
