"""Selection of columns by metadata: fields, categories and their tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varistrata.sources.scratch import cut_lineage
from varistrata.sources.tables import parse_udis, write_subset

# Codes of value types.
VALUE_TYPES = {
    "integer": [11],
    "categorical_single": [21],
    "categorical_multiple": [22],
    "continuous": [31],
    "text": [41],
    "date": [51],
    "time": [61],
    "compound": [101],
    "categorical": [21, 22],
    "numeric": [11, 21, 22, 31],
    "all": [11, 21, 22, 31, 41, 51, 61, 101],
}


def value_types(wanted: str | int | Sequence) -> list[int]:
    if isinstance(wanted, str):
        if wanted not in VALUE_TYPES:
            raise ValueError(f"unknown value type {wanted}")
        return VALUE_TYPES[wanted]
    codes = [wanted] if isinstance(wanted, int) else [c for w in wanted for c in (value_types(w) if isinstance(w, str) else [w])]
    if unknown := set(codes) - set(VALUE_TYPES["all"]):
        raise ValueError(f"unknown value types {sorted(unknown)}")
    return codes


def category_closure(tree: DataFrame, roots: Sequence) -> DataFrame:
    """category_id of the roots and all below them in (parent_id, child_id), each once; a cycle ends the walk."""
    spark = tree.sparkSession
    kind = tree.schema["parent_id"].dataType.simpleString()
    start = spark.createDataFrame([(r,) for r in roots], f"category_id {kind}").distinct()
    seen, frontier = start, start
    while True:
        below = frontier.join(tree, frontier["category_id"] == tree["parent_id"]).select(F.col("child_id").alias("category_id")).distinct()
        frontier = cut_lineage(below.join(seen, "category_id", "left_anti"))  # or the plan doubles with each level
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.distinct()


def fields_of_categories(fields: DataFrame, tree: DataFrame, recommended: DataFrame, roots: Sequence) -> DataFrame:
    """field_id of the fields whose main category is in the closure of the roots, or that are recommended for one."""
    inside = category_closure(tree, roots)
    main = fields.join(inside, fields["main_category"] == inside["category_id"], "left_semi").select("field_id")
    return main.unionByName(recommended.join(inside, "category_id", "left_semi").select("field_id")).distinct()


def filter_by_title(fields: DataFrame, pattern: str, keep: bool = True) -> DataFrame:
    """The title is searched for a regular expression, not for a plain string."""
    hit = F.col("title").rlike(pattern)
    return fields.where(hit if keep else ~hit)


def filter_by_value_type(fields: DataFrame, wanted: str | int | Sequence, keep: bool = True) -> DataFrame:
    hit = F.col("value_type").isin(value_types(wanted))
    return fields.where(hit if keep else ~hit)


def filter_by_instance(udis: DataFrame, instances: Sequence[int] | str = "all", keep: str = "all") -> DataFrame:
    """Column identifiers of some instances; keep="max": of those only the largest of each field and array index."""
    allowed = [0, 1, 2, 3] if instances == "all" else list(instances)
    if unknown := set(allowed) - {0, 1, 2, 3}:
        raise ValueError(f"unknown instances {sorted(unknown)}")
    out = udis.where(F.col("instance").isin(allowed))
    if keep == "max":
        top = F.max("instance").over(Window.partitionBy("field_id", "array_index"))
        out = out.withColumn("_top", top).where("instance = _top").drop("_top")
    elif keep != "all":
        raise ValueError(f"unknown choice {keep}")
    return out


def filter_by_field(udis: DataFrame, fields: DataFrame, keep: bool = True) -> DataFrame:
    return udis.join(fields.select("field_id").distinct(), "field_id", "left_semi" if keep else "left_anti")


def merged_catalog(udis: DataFrame, fields: DataFrame, categories: DataFrame) -> DataFrame:
    """Column identifiers with title_field and title_category; those without a field or category are left out."""
    f = fields.withColumnRenamed("title", "title_field")
    c = categories.select(F.col("category_id"), F.col("title").alias("title_category"))
    return udis.join(f, "field_id").join(c, F.col("main_category") == F.col("category_id"))


def udis_of_category(catalog: DataFrame, categories: Sequence[int], keep: bool = True, udis: DataFrame | None = None) -> DataFrame:
    """Rows of the merged catalogue (of the udis, if given, all of which must be there) whose main category is one of those, or isn't."""
    hit = F.col("main_category").isin(list(categories))
    return (catalog if udis is None else require(catalog, udis)).where(hit if keep else ~hit)


def udis_of_value_type(catalog: DataFrame, wanted: str | int | Sequence, keep: bool = True, udis: DataFrame | None = None) -> DataFrame:
    return filter_by_value_type(catalog if udis is None else require(catalog, udis), wanted, keep)


def categories_of_udis(catalog: DataFrame, udis: DataFrame, distinct: bool = True) -> DataFrame:
    """main_category and title_category of the udis, each once or once for each udi; one that is not in the catalogue is an error."""
    found = require(catalog, udis).select("main_category", "title_category")
    return found.distinct() if distinct else found


def category_title(categories: DataFrame, category_id: int) -> str:
    row = categories.where(F.col("category_id") == category_id).select("title").first()
    if row is None:
        raise KeyError(f"no category {category_id}")
    return row[0]


def field_info(table: DataFrame, ids: Sequence[int], key: str = "field_id") -> DataFrame:
    """The rows of a dictionary table (fields, categories, column identifiers) for some of its keys; a key that isn't there is an error."""
    wanted = table.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` {table.schema[key].dataType.simpleString()}").distinct()
    return require(table, wanted, key)


def require(catalog: DataFrame, udis: DataFrame, column: str = "udi") -> DataFrame:
    """The catalogue's rows for all udis; one that is not there is an error."""
    gone = [r[0] for r in udis.join(catalog, column, "left_anti").select(column).limit(5).collect()]
    if gone:
        raise KeyError(f"not in the catalogue: {gone}")
    return udis.join(catalog, column)


def select_columns(
    udis: DataFrame, fields: DataFrame, tree: DataFrame, recommended: DataFrame, categories: Sequence = (), extra_fields: Sequence[int] = (), types: str | Sequence = "all",
    keep_types: bool = True, title: str | None = None, keep_title: bool = True, titles_reject: Sequence[str] = (), instances: Sequence[int] | str = "all", keep_instance: str = "all",
) -> DataFrame:
    """Categories and single fields, then value types, titles and instances, as column identifiers.

    What is "all" is not filtered by: fields of no or an unknown value type stay, and so does any instance.
    """
    chosen = fields_of_categories(fields, tree, recommended, categories)
    if extra_fields:
        chosen = chosen.unionByName(fields.sparkSession.createDataFrame([(f,) for f in extra_fields], chosen.schema)).distinct()
    out = fields.join(chosen, "field_id", "left_semi")
    if types != "all":
        out = filter_by_value_type(out, types, keep_types)
    if title is not None:
        out = filter_by_title(out, title, keep_title)
    for pattern in titles_reject:
        out = filter_by_title(out, pattern, keep=False)
    found = filter_by_field(udis, out)
    return found if instances == "all" and keep_instance == "all" else filter_by_instance(found, instances, keep_instance)


def unencoded(name: str | Column) -> Column:
    """The column identifier before any encoding suffix."""
    return F.substring_index(F.col(name) if isinstance(name, str) else name, "_", 1)


def labels(encoded: DataFrame, catalog: DataFrame, with_category: bool = False, column: str = "udi_encoded", suffixes: bool = True) -> DataFrame:
    """encoded with `label`: [category] title (suffix); the suffixes orig and squared are not shown, a name without one is its own suffix. suffixes=False: titles only."""
    suffix = F.substring_index(F.col(column), "_", -1)
    text = F.when(suffix.isin("orig", "squared") | F.lit(not suffixes), F.col("title_field")).otherwise(F.concat("title_field", F.lit(" ("), suffix, F.lit(")")))
    if with_category:
        text = F.concat(F.lit("["), "title_category", F.lit("] "), text)
    names = catalog.select("udi", "title_field", "title_category")
    keyed = encoded.withColumn("udi", unencoded(column))
    return keyed.join(names, "udi").withColumn("label", text).drop("title_field", "title_category")


#: Named column domains as arguments of select_columns.
# Categories, fields, title patterns and instances of the domains.
DOMAINS = {
    "behavioural": {
        "categories": [100026],
        "titles_reject": [
            "Index for card",
            "Completion status of numeric memory test",
            "Round of numeric memory test",
            "Number of digits to be memorised/recalled",
            "Target number to be",
            "Number entered by participant",
            "Time number displayed for",
            "Digits entered correctly",
            "Time first key touched",
            "Time elapsed",
            "Keystroke history",
            "Attempted fluid intelligence (FI) test",
            "Item selected for each puzzle",
            "Values entered",
            "Values wanted",
            "First code array presented",
            "Value entered",
            "Test completion status",
            "PM: initial answer",
            "PM: final answer",
            "Final attempt correct",
            "History of attempts",
            "Duration screen displayed",
            "Time when initial screen shown",
            "Time screen exited",
            "Time to answer",
            "Number of columns displayed in round",
            "Number of rows displayed in round",
            "Screen layout",
        ],
        "instances": [2],
    },
    "brain": {"categories": [135], "titles_reject": ["L1", "L2", "L3"], "instances": [2]},
    "demographic": {
        "categories": [1001, 100011],
        "extra_fields": [4194, 50, 21002, 21, 1707],
        "titles_reject": ["Place of birth in UK", "Time since interview start at which blood pressure screen(s) shown"],
        "instances": [0, 2],
        "keep_instance": "max",
    },
    "disease": {"categories": [2002], "title": "ICD10", "instances": [0, 1, 2]},
    "demographic-instance0": {"extra_fields": [21000, 1707], "instances": [0], "keep_instance": "max"},
    "viprs": {"categories": [110], "instances": [2]},
    "freesurfer_dkt_aseg": {"categories": [190, 196], "instances": [2]},
}


def select_domain(name: str, data: DataFrame, path: str, fields: DataFrame, tree: DataFrame, recommended: DataFrame, key: str = "eid") -> tuple[dict, tuple[int, int]]:
    """Write the columns of a named domain to Parquet; its settings, with the columns found, and the rows and columns written."""
    if name not in DOMAINS:
        raise ValueError(f"unknown domain {name}: one of {', '.join(DOMAINS)}")
    udis = parse_udis(data.sparkSession, [c for c in data.columns if c != key])
    found = [r["udi"] for r in select_columns(udis, fields, tree, recommended, **DOMAINS[name]).select("udi").collect()]
    wanted = set(found)
    chosen = [c for c in data.columns if c in wanted]
    return DOMAINS[name] | {"columns": chosen}, write_subset(data, path, chosen, key=key)
