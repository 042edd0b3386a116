"""SPARQL Update on data sets of triple tables: each operation makes new snapshots, computed before any is swapped in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tarn.functions.terms import lexical
from tarn.operators.lineage import cut
from tarn.operators.relation import unit
from tarn.plans.compiler import Compiler, Context, Options
from tarn.plans.parser import Update
from tarn.sources.graphs import COLUMNS, Dataset, Graph, TriplesGraph, empty_graph
from tarn.sources.rdf import read_rdf


class UpdateError(RuntimeError):
    pass


class Updater:
    def __init__(self, dataset: Dataset, options: Options | None = None):
        self.dataset, self.options, self.spark = dataset, options or Options(), dataset.spark

    def execute(self, updates: list[Update]) -> None:
        """In sequence; each sees what the ones before it did."""
        for u in updates:
            getattr(self, {"data": "modify", "add": "transfer", "copy": "transfer", "move": "transfer"}.get(u.kind, u.kind))(u)
        if self.options.cache is not None:
            self.options.cache.clear()

    def table(self, iri: str | None, make: bool = True) -> TriplesGraph:
        if iri is None or iri == self.dataset.default_iri:
            g: Graph = self.dataset.default
        else:
            if make and not self.dataset.has(iri) and not self.dataset.factory:
                self.dataset.add(iri, empty_graph(self.spark))
            g = self.dataset.get(iri)
        if not isinstance(g, TriplesGraph):
            raise UpdateError(f"the graph {iri or 'DEFAULT'} can't be changed")
        return g

    def modify(self, u: Update) -> None:
        """Deletes, then inserts, the templates' triples for all solutions of one evaluation of WHERE."""
        graph = self.dataset.get(u.with_graph) if u.with_graph else self.dataset.default
        key = u.with_graph or self.dataset.default_iri
        if u.using:
            graph, key = self.dataset.union_graph(u.using), "+".join(u.using)
        compiler = Compiler(self.dataset, self.options)
        rel = compiler.group(u.where, Context(graph, tuple(u.using_named) if u.using_named else None, key)) if u.where else unit(self.spark)
        if rel.vars:
            rel.df = cut(rel.df)
        changes: dict[str | None, dict[str, list[DataFrame]]] = {}
        for what, quads in (("delete", u.delete), ("insert", u.insert)):
            for g, triples in quads:
                iris = [g[1] if g and g[0] == "iri" else u.with_graph]
                if g and g[0] == "var":
                    iris = [r[0] for r in rel.df.select(lexical(rel.e(g[1]))).distinct().collect() if r[0] is not None]  # graphs, not rows
                for iri in iris:
                    sub = rel if not (g and g[0] == "var") else rel.where(lexical(rel.e(g[1])) == iri)
                    changes.setdefault(iri, {}).setdefault(what, []).append(compiler.instantiated(triples, sub))
        new = {}
        for iri, c in changes.items():
            df = self.table(iri).df
            if "delete" in c:
                df = df.join(reduce(DataFrame.unionByName, c["delete"]).distinct(), COLUMNS, "left_anti")
            if "insert" in c:
                df = df.unionByName(reduce(DataFrame.unionByName, c["insert"])).distinct()
            new[iri] = self.table(iri).snapshot(df)
        for iri, df in new.items():
            self.table(iri).swap(df)

    def create(self, u: Update) -> None:
        if self.dataset.has(u.target):
            if not u.silent:
                raise UpdateError(f"the graph {u.target} exists")
            return
        self.dataset.add(u.target, self.dataset.factory(u.target) if self.dataset.factory else empty_graph(self.spark))

    def drop(self, u: Update) -> None:
        """DROP DEFAULT makes another named graph the default one; DROP ALL and NAMED remove the named graphs."""
        if u.target == "DEFAULT":
            if not self.dataset.named:
                if not u.silent:
                    raise UpdateError("there is no other graph to be the default one")
                return
            iri = next(iter(self.dataset.named))
            self.dataset.default.drop()
            self.dataset.default, self.dataset.default_iri = self.dataset.named.pop(iri), iri
        elif u.target in ("ALL", "NAMED"):
            for iri in list(self.dataset.named):
                self.dataset.get(iri).drop()
                self.dataset.delete(iri)
        elif self.dataset.has(u.target):
            self.dataset.get(u.target).drop()
            self.dataset.delete(u.target)
        elif not u.silent:
            raise UpdateError(f"there is no graph {u.target}")

    def clear(self, u: Update) -> None:
        if u.target in ("DEFAULT", "NAMED", "ALL"):
            iris = ([None] if u.target != "NAMED" else []) + (list(self.dataset.named) if u.target != "DEFAULT" else [])
        elif self.dataset.has(u.target) or u.target == self.dataset.default_iri:
            iris = [u.target]
        elif u.silent:
            return
        else:
            raise UpdateError(f"there is no graph {u.target}")
        for iri in iris:
            self.table(iri).clear()

    def transfer(self, u: Update) -> None:
        """ADD, COPY and MOVE; onto itself a graph stays as it is."""
        source, target = (None if g in ("DEFAULT", self.dataset.default_iri) else g for g in (u.source, u.target))
        if source is not None and not self.dataset.has(source) and not self.dataset.factory:
            if u.silent:
                return
            raise UpdateError(f"there is no graph {source}")
        if source == target:
            return
        df = self.table(source).df
        t = self.table(target)
        if u.kind == "add":
            t.insert(df)
        else:
            t.swap(df)
        if u.kind == "move":
            self.table(source).clear()
            if source is not None:
                self.dataset.delete(source)

    def load(self, u: Update) -> None:
        try:
            df = cut(read_rdf(self.spark, u.source))  # what a file's text raises must show here
        except Exception as e:
            if u.silent:
                return
            raise UpdateError(f"{u.source} can't be read") from e
        self.table(None if u.target == "DEFAULT" else u.target).insert(df)

