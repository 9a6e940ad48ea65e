"""Selection of subjects: presence, withdrawal, sub-cohorts by disease codes, and alignment of datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes of the sub-cohorts.
PSYCHOACTIVE_CODES = ["Z864"]
PSYCHOACTIVE_PREFIXES = ["F10", "F11", "F12", "F13", "F14", "F15", "F16", "F17", "F18", "F19"]
HYPERTENSION_CODES = ["I10"]


def any_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in columns])


def all_missing(columns: Sequence[str]) -> Column:
    return ~any_present(columns)


def with_any_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in one of the columns."""
    return df.where(any_present(columns))


def without_subjects(df: DataFrame, gone: DataFrame, key: str = "eid", strict: bool = False) -> DataFrame:
    """Rows whose key isn't in gone; strict: each of gone must be there."""
    ids = gone.select(key).distinct()
    if strict and not ids.join(df, key, "left_anti").isEmpty():
        raise KeyError("subjects to drop are not in the table")
    return df.join(ids, key, "left_anti")


def _codes(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("string") for c in columns])


def any_code(columns: Sequence[str], codes: Sequence[str] = (), prefixes: Sequence[str] = ()) -> Column:
    """Whether a column has one of the codes, or begins with one of the prefixes of 3; false, not null, if none does."""
    hit = lambda x: x.isin(list(codes)) | F.substring(x, 1, 3).isin(list(prefixes))
    return F.coalesce(F.exists(_codes(columns), hit), F.lit(False))


def _registry() -> dict[str, Callable[[Sequence[str]], Column]]:
    psycho = lambda c: any_code(c, PSYCHOACTIVE_CODES, PSYCHOACTIVE_PREFIXES)
    hyper = lambda c: any_code(c, HYPERTENSION_CODES)
    return {
        "all": lambda c: F.lit(True),
        "psychoactive": psycho,
        "hypertension": hyper,
        "healthy": all_missing,
        "psychoactive_no_overlap": lambda c: psycho(c) & ~hyper(c),
        "hypertension_no_overlap": lambda c: hyper(c) & ~psycho(c),
        "hyperpsycho": lambda c: hyper(c) & psycho(c),
    }


#: Sub-cohorts by name: predicates over the disease columns.
SUBSETS = _registry()


def subset(df: DataFrame, name: str, disease_columns: Sequence[str]) -> DataFrame:
    if name not in SUBSETS:
        raise ValueError(f"unknown subset {name}")
    return df.where(SUBSETS[name](disease_columns))


def aligned(left: DataFrame, right: DataFrame, key: str = "eid") -> DataFrame:
    """Columns of both by key; different sets of subjects are an error."""
    a, b = left.select(key), right.select(key)
    if not a.join(b, key, "left_anti").isEmpty() or not b.join(a, key, "left_anti").isEmpty():
        raise ValueError("the datasets have different subjects")
    return left.join(right, key)


@dataclass(frozen=True)
class StudyData:
    """One wide table with the columns of each dataset, and further tables of the same subjects."""

    frame: DataFrame
    datasets: dict[str, list[str]] = field(default_factory=dict)
    extra: dict[str, DataFrame] = field(default_factory=dict)
    confounds: str | None = None
    group: DataFrame | None = None
    holdout: DataFrame | None = None
    key: str = "eid"

    @staticmethod
    def of(key_frame: DataFrame, key: str = "eid") -> StudyData:
        return StudyData(key_frame.select(key), key=key)

    def add_dataset(self, name: str, df: DataFrame) -> StudyData:
        """Columns get the dataset's name in front; the subjects must be the same."""
        if name in self.datasets:
            raise RuntimeError(f"there is a dataset {name}")
        named = {c: f"{name}__{c}" for c in df.columns if c != self.key}
        return replace(self, frame=aligned(self.frame, df.withColumnsRenamed(named), self.key), datasets=self.datasets | {name: list(named.values())})

    def add_extra(self, name: str, df: DataFrame) -> StudyData:
        if name in self.extra:
            raise RuntimeError(f"there is a further table {name}")
        aligned(self.frame.select(self.key), df, self.key)
        return replace(self, extra=self.extra | {name: df})

    def _once(self, what: str, value) -> StudyData:
        if getattr(self, what) is not None:
            raise RuntimeError(f"{what} is set")
        return replace(self, **{what: value})

    def set_confounds(self, dataset: str) -> StudyData:
        if dataset not in self.datasets:
            raise ValueError(f"no dataset {dataset}")
        return self._once("confounds", dataset)

    def set_group(self, df: DataFrame) -> StudyData:
        return self._once("group", df)

    def set_holdout(self, df: DataFrame) -> StudyData:
        return self._once("holdout", df)

    def subset(self, subjects: DataFrame) -> StudyData:
        """Those subjects in all tables."""
        cut = lambda df: None if df is None else df.join(subjects.select(self.key).distinct(), self.key, "left_semi")
        return replace(self, frame=cut(self.frame), extra={n: cut(d) for n, d in self.extra.items()}, group=cut(self.group), holdout=cut(self.holdout))

    def filter(self, fn: Callable[[DataFrame], Column]) -> StudyData:
        return self.subset(self.frame.where(fn(self.frame)))


def join_extracts(extracts: Sequence[DataFrame], key: str = "eid") -> DataFrame:
    """Columns of several extracts side by side; a subject that one lacks stays, with NULL. A column that two have is an error."""
    out = extracts[0]
    for e in extracts[1:]:
        if twice := (set(out.columns) & set(e.columns)) - {key}:
            raise ValueError(f"columns {sorted(twice)} are in two extracts")
        out = out.join(e, key, "full_outer")
    return out


def build_study(datasets: dict[str, DataFrame], extra: dict[str, DataFrame] | None = None, confounds: str | None = None, group: DataFrame | None = None, holdout: DataFrame | None = None, key: str = "eid") -> StudyData:
    """All datasets of one cohort as one wide table; the first gives the subjects, and all must have the same."""
    if not datasets:
        raise ValueError("no datasets")
    out = StudyData.of(next(iter(datasets.values())), key)
    for name, df in datasets.items():
        out = out.add_dataset(name, df)
    for name, df in (extra or {}).items():
        out = out.add_extra(name, df)
    if confounds is not None:
        out = out.set_confounds(confounds)
    if group is not None:
        out = out.set_group(group)
    return out if holdout is None else out.set_holdout(holdout)


def select_rows(data, at, key: str = "eid"):
    """Rows at the places of a numpy array, or of each of a list of them.

    Of a DataFrame, whose rows have no places, the rows of the keys of another one (a sample), as often as those are there, with its other columns.
    """
    if isinstance(data, DataFrame):
        return data.join(at, key)
    return [select_rows(x, at, key) for x in data] if isinstance(data, list) else data[at]
