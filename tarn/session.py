"""The front door: SparqlSession.query(text) gives a DataFrame, update(text) changes the data set."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from tarn.operators import results
from tarn.operators.cache import BGPCache
from tarn.operators.relation import Relation
from tarn.operators.update import Updater
from tarn.plans.compiler import Compiler, Options
from tarn.plans.parser import Query, parse_query, parse_update
from tarn.sources.graphs import Dataset, Graph


class SparqlSession:
    def __init__(self, dataset: Dataset | Graph, prefixes: dict[str, str] | None = None, options: Options | None = None):
        self.dataset = dataset if isinstance(dataset, Dataset) else Dataset(dataset)
        self.prefixes, self.options = dict(prefixes or {}), options or Options()

    def use_cache(self, cache: BGPCache | None = None) -> BGPCache:
        self.options.cache = cache if cache is not None else BGPCache()
        return self.options.cache

    def parse(self, text: str) -> Query:
        return parse_query(text, self.prefixes)

    def query(self, text: str, native: bool = True, dedupe: bool = True) -> DataFrame:
        """SELECT: a column for each variable, native or as N3 text; CONSTRUCT and DESCRIBE: triples; ASK: the column answer."""
        q = self.parse(text)
        c = Compiler(self.dataset, self.options)
        if q.form == "select":
            return c.select(q, native)
        if q.form == "construct":
            return c.construct(q, dedupe)
        return c.ask(q) if q.form == "ask" else c.describe(q)

    def ask(self, text: str) -> bool:
        return self.query(text).first()["answer"]

    def formatted(self, text: str, form: str = "json", compat: bool = False) -> str:
        """A SELECT's or ASK's result as json, xml, csv or tsv."""
        q = self.parse(text)
        c = Compiler(self.dataset, self.options)
        if q.form == "ask":
            answer = c.ask(q).first()["answer"]
            return {"json": results.ask_json, "xml": results.ask_xml, "csv": results.ask_separated, "tsv": results.ask_separated}[form](answer)
        return results.text(self.parts(c.solutions(q), form, compat))

    @staticmethod
    def parts(rel: Relation, form: str, compat: bool = False) -> Iterator[str]:
        if form == "json":
            return results.to_json(rel)
        return results.to_xml(rel) if form == "xml" else results.to_separated(rel, {"csv": ",", "tsv": "\t"}[form], compat)

    def streamed(self, text: str, form: str = "json", compat: bool = False) -> Iterator[str]:
        """A SELECT's result in pieces, of which the driver holds those of one partition at a time."""
        return self.parts(Compiler(self.dataset, self.options).solutions(self.parse(text)), form, compat)

    def formatted_rows(self, text: str, form: str = "json", compat: bool = False) -> DataFrame:
        """A SELECT's rows as text, distributed; to be written to files."""
        return results.rows(Compiler(self.dataset, self.options).solutions(self.parse(text)), form, compat)

    def update(self, text: str) -> None:
        Updater(self.dataset, self.options).execute(parse_update(text, self.prefixes))
