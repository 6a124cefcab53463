"""The document index: ids, forms and years told from text, the latest document per id and form, and its notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import told
from ..functions.text import document_id, index_id, index_year, period_label, without_ids
from ..functions.vocabulary import FORM_PATTERNS, java

PERIOD = "struct<label:string,year:int>"
#: Documents of one id and form that are held in one row.
FEW = 256


def forms_of(text: Column) -> Column:
    """The forms whose header stands in a text: bu, then bs; both may."""
    return F.array_compact(F.array(*[F.when(text.rlike(java(p)), F.lit(form)) for form, p in FORM_PATTERNS.items()]))


def year_alone(text: Column) -> Column:
    """A period of which the year alone is told; the digits of a company's id tell none."""
    return F.struct(F.lit(None).cast("string").alias("label"), index_year(without_ids(text)).alias("year"))


Detector = Callable[[Column], Column]


def classify(documents: DataFrame, id_of: Detector = document_id, forms: Detector = forms_of, period_of: Detector = year_alone) -> DataFrame:
    """documents (path, text, mtime) with mb_key, forms and period; mb_key is null and forms empty where nothing is told.

    Each of the three may be told by another function of the text."""
    text = F.coalesce("text", F.lit(""))
    return documents.withColumns({"mb_key": id_of(text), "forms": forms(text), "period": period_of(text)})


def entries_of(classified: DataFrame) -> DataFrame:
    """One row per document and form."""
    return classified.where("mb_key is not null").select("*", F.explode("forms").alias("form_type")).drop("forms")


def unclassified(classified: DataFrame) -> DataFrame:
    return classified.where("mb_key is null").select("path")


def rank_of(period: Column) -> Column:
    """Current years before previous ones before unlabelled ones, later years first."""
    base = F.when(period_label(period["label"]) == "current", 2).when(period_label(period["label"]) == "previous", 1).otherwise(0)
    return F.coalesce(base * 10_000 + F.coalesce(period["year"], F.lit(0)), F.lit(0))


def path_key(path: Column) -> Column:
    """Sort key of paths, component by component."""
    return F.split(path, "/")


def latest(entries: DataFrame, preferred: str | None = None) -> DataFrame:
    """The document to use per id and form: preferred period first, then rank and time, later ones first; ties by path."""
    label = period_label(F.col("period.label"))
    wanted = F.lit(False) if preferred is None else F.coalesce(label == period_label(F.lit(preferred)), F.lit(False))
    # The least in order, summed up map-side: however many documents one id has, no task gathers them.
    order = F.struct((~wanted).alias("other"), (-rank_of(F.col("period"))).alias("rank"), F.coalesce(-F.unix_micros(F.col("mtime").cast("timestamp")), F.lit((1 << 63) - 1)).alias("time"), path_key(F.col("path")).alias("path"))
    return entries.groupBy("mb_key", "form_type").agg(F.min_by(F.struct(*[c for c in entries.columns if c not in ("mb_key", "form_type")]), order).alias("row")).select("mb_key", "form_type", "row.*")


KEYS = ["mb_key", "form_type"]


def registrations(entries: DataFrame) -> DataFrame:
    """One row for each document of a company and form that has several: mb_key, form_type, n, ord, place and path.

    ord is the document's number in the order of paths, place its number in the order of choice. It is listed in the notes
    from number ord to the last, n, so these rows tell all notes in a size that grows with the documents alone. A path is one document:
    equal rows count once. Documents are numbered by sorts that spill, and no row holds more than one of them."""
    item = [(-rank_of(F.col("period"))).alias("rank"), (-F.unix_micros("mtime")).alias("time"), path_key(F.col("path")).alias("order"), "path"]
    items = entries.select(*KEYS, *item).distinct()
    sizes = items.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1")
    of_key = Window.partitionBy(*KEYS)
    numbers = {"ord": F.row_number().over(of_key.orderBy("order", "rank", "time")), "place": F.row_number().over(of_key.orderBy("rank", "time", "order"))}
    return items.join(sizes, KEYS).withColumns(numbers).select(*KEYS, "n", "ord", "place", "path")


def notes_of_registrations(found: DataFrame) -> DataFrame:
    """The notes that registrations tell, as text: mb_key, form_type, ord and note, at each document but a company's first.

    The text of a company's last note lists all its documents, so all its notes together are of square size; they should be made for
    companies that are reported only. Those of a company with up to FEW documents are made in one row, those of a larger one in many tasks."""
    item = F.struct("place", "ord", "path")
    listed = lambda all_, last: F.filter(all_, lambda i: i["ord"] <= last)
    few = found.where(F.col("n") <= FEW).groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("all"))
    of_few = few.select(*KEYS, "all", F.explode(F.sequence(F.lit(2), F.size("all"))).alias("ord")).select(*KEYS, "ord", listed(F.col("all"), F.col("ord")).alias("held"))

    many = found.where(F.col("n") > FEW).withColumn("blocks", F.ceil(F.col("n") / FEW))
    newcomers = many.where("ord > 1").select(*KEYS, F.pmod("ord", "blocks").alias("block"), F.col("ord").alias("last"))
    candidates = many.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), item.alias("item"))
    so_far = newcomers.join(candidates, [*KEYS, "block"]).where("item.ord <= last")
    of_many = so_far.groupBy(*KEYS, "block", "last").agg(F.array_sort(F.collect_list("item")).alias("held")).select(*KEYS, F.col("last").alias("ord"), "held")

    paths = F.array_join("held.path", ", ")
    return of_few.unionByName(of_many).select(*KEYS, "ord", told("duplicates", F.upper("form_type"), F.col("mb_key"), paths).alias("note"))


def duplicate_notes(entries: DataFrame) -> DataFrame:
    """A note at each registration after the first of an id and form: mb_key, form_type, ord (path order) and note, the candidates so far in order of choice."""
    return notes_of_registrations(registrations(entries))


def index_notes(classified: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """mb_key, notes (ordered): documents of unknown form, then duplicates form by form; of `companies` (mb_key) alone if they are given."""
    known = classified.where("mb_key is not null")
    if companies is not None:
        known = known.join(companies.select("mb_key").distinct(), "mb_key", "left_semi")
    text = told("unknown_form", F.col("path"), F.col("mb_key"))
    unknown = known.where("size(forms) = 0").select("mb_key", F.lit("unknown").alias("form_type"), path_key(F.col("path")).alias("p"), text.alias("note"))
    doubles = duplicate_notes(entries_of(known)).select("mb_key", "form_type", F.array(F.format_string("%010d", "ord")).alias("p"), "note")
    both = unknown.unionByName(doubles)
    ordered = F.array_sort(F.collect_list(F.struct("form_type", "p", "note")))
    return both.groupBy("mb_key").agg(F.transform(ordered, lambda n: n["note"]).alias("notes"))


def roster_key(mb: Column) -> Column:
    return index_id(mb)
