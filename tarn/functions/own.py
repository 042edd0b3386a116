"""Functions of the user's own on whole RDF terms, in plain Python, run over Arrow batches.

A function gets and gives terms as n3 text (an IRI bare, "literal", "literal"@lang, "literal"^^datatype, _:label), the same
text that query(native=False) shows; None is unbound or an error. A generator gives a list, a solution for each item.
Functions of typed columns (Options.functions) stay in the JVM; these are for what columns can't express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tarn.functions.terms import E, n3, of_n3


def own_function(f: Callable[..., object], many: bool = False) -> Callable[[list[E]], object]:
    """f, of n3 texts, for Options.functions; many: f gives a list of them. What f raises is an error of that row: unbound."""

    @F.udf(returnType=ArrayType(StringType()) if many else StringType(), useArrow=True)
    def run(*texts):
        try:
            return f(*texts)
        except Exception:
            return None

    def on(args: list[E]):
        out = run(*[n3(a) for a in args])
        return (E("term", of_n3(F.lit(""))), F.transform(out, of_n3)) if many else E("term", of_n3(out))

    return on
