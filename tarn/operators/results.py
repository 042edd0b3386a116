"""Results as text: SPARQL JSON, XML, CSV and TSV. rows() keeps them distributed, a column of text; to_*() pass them through the driver one by one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.terms import XSD, box, n3
from tarn.operators.relation import Relation


def rows(rel: Relation, form: str, compat: bool = False) -> DataFrame:
    """A column `row` with the text of each solution in json, xml, csv or tsv, without what stands around and between them."""
    if form == "json":
        return json_rows(rel)
    if form == "xml":
        return xml_rows(rel)
    return separated_rows(rel, {"csv": ",", "tsv": "\t"}[form], compat)


def json_rows(rel: Relation) -> DataFrame:
    """Unbound variables are left out."""
    cols = []
    for n in rel.vars:
        c = box(rel.e(n))
        kind = F.when(c["k"] == "i", "uri").when(c["k"] == "b", "bnode").otherwise("literal")
        plain = c["dt"].isin("", XSD + "string")
        datatype = F.when((c["lang"] == "") & ~plain, c["dt"])
        s = F.struct(kind.alias("type"), c["v"].alias("value"), F.when(c["lang"] != "", c["lang"]).alias("xml:lang"), datatype.alias("datatype"))
        cols.append(F.when(c.isNotNull(), s).alias(n))
    return rel.df.select((F.to_json(F.struct(*cols)) if cols else F.lit("{}")).alias("row"))


def to_json(rel: Relation) -> Iterator[str]:
    names = ", ".join(f'"{n}"' for n in rel.vars)
    yield f'{{"head": {{"vars": [{names}]}}, "results": {{"bindings": ['
    for k, r in enumerate(json_rows(rel).toLocalIterator()):
        yield (",\n" if k else "\n") + r["row"]
    yield "\n]}}"


def ask_json(answer: bool) -> str:
    return f'{{"head": {{}}, "boolean": {str(answer).lower()}}}'


def quoted(c: Column) -> Column:
    """A CSV cell: quoted where it has a quote, comma or line break."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def tsv_cell(e) -> Column:
    c = box(e)
    text = F.replace(F.replace(F.replace(F.replace(c["v"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(c["lang"] != "", F.concat(F.lit("@"), c["lang"])).when(c["dt"].isin("", XSD + "string"), F.lit("")).otherwise(F.concat(F.lit("^^<"), c["dt"], F.lit(">"))))
    return F.when(c["k"] == "i", F.concat(F.lit("<"), c["v"], F.lit(">"))).when(c["k"] == "b", F.concat(F.lit("_:"), c["v"])).when(c["k"] == "l", literal)


def separated_rows(rel: Relation, separator: str, compat: bool = False) -> DataFrame:
    """CSV (',') or TSV (tab). compat: cells are N3 texts as they are, and unbound ones are left out."""
    names = list(rel.vars)
    tsv = separator == "\t"
    if compat:
        cells = [n3(rel.e(n)) for n in names]
    elif tsv:
        cells = [F.coalesce(tsv_cell(rel.e(n)), F.lit("")) for n in names]
    else:
        cells = [F.coalesce(quoted(F.when(box(rel.e(n))["k"] == "b", n3(rel.e(n))).otherwise(box(rel.e(n))["v"])), F.lit("")) for n in names]
    return rel.df.select(F.concat_ws(separator, *cells).alias("row"))


def to_separated(rel: Relation, separator: str, compat: bool = False) -> Iterator[str]:
    yield separator.join(("?" + n if separator == "\t" and not compat else n) for n in rel.vars) + "\n"
    for r in separated_rows(rel, separator, compat).toLocalIterator():
        yield r["row"] + "\n"


def ask_separated(answer: bool) -> str:
    return f"boolean\n{str(answer).lower()}\n"


def xml_text(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def xml_rows(rel: Relation) -> DataFrame:
    """Unbound variables are left out."""
    cells = [F.lit("<result>")]
    for n in rel.vars:
        c = box(rel.e(n))
        tagged = lambda tag, text, more="": F.concat(F.lit(f"<{tag}"), F.lit(more) if isinstance(more, str) else more, F.lit(">"), text, F.lit(f"</{tag}>"))
        of_literal = F.when(c["lang"] != "", F.concat(F.lit(' xml:lang="'), xml_text(c["lang"]), F.lit('"')))
        of_literal = of_literal.when(c["dt"].isin("", XSD + "string"), F.lit("")).otherwise(F.concat(F.lit(' datatype="'), xml_text(c["dt"]), F.lit('"')))
        v = xml_text(c["v"])
        x = F.when(c["k"] == "i", tagged("uri", v)).when(c["k"] == "b", tagged("bnode", v)).otherwise(tagged("literal", v, of_literal))
        cells.append(F.when(c.isNotNull(), F.concat(F.lit(f'<binding name="{n}">'), x, F.lit("</binding>"))).otherwise(F.lit("")))
    return rel.df.select(F.concat(*cells, F.lit("</result>")).alias("row"))


def to_xml(rel: Relation) -> Iterator[str]:
    names = "".join(f'<variable name="{n}"/>' for n in rel.vars)
    yield f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head>{names}</head>\n<results>\n'
    for r in xml_rows(rel).toLocalIterator():
        yield r["row"] + "\n"
    yield "</results>\n</sparql>\n"


def ask_xml(answer: bool) -> str:
    return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head/>\n<boolean>{str(answer).lower()}</boolean>\n</sparql>\n'


def text(parts: Iterator[str]) -> str:
    return "".join(parts)
