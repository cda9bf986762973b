"""Council meetings, minutes, members and elections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import iso_time, share_pct, stable_id, text_or, url_parameter
from tessera.functions.text import html_to_text, parse_minutes
from tessera.schema import node_id
from tessera.sources.common import emit, relation

C = F.col
MINUTES = "council_minutes"


def gremientermine(raw: DataFrame, now: Column) -> DataFrame:
    """Scheduled meetings; the id changes with date, body or time. Times are taken as UTC."""
    body, begin = text_or(C("gremium"), "Unbekanntes Gremium"), F.coalesce("beginn", F.lit("00:00:00"))
    datum = F.coalesce("datum", F.lit(""))
    at = F.concat_ws("T", F.substring(datum, 1, 10), begin).try_cast("timestamp")
    props = {"gremium": body, "datum": datum, "beginn": begin, "sitzungsort": C("sitzungsort"), "meeting_type": F.lit("scheduled")}
    return emit(raw, "Meeting", "council_schedule", stable_id(datum, body, begin), F.concat_ws(" ", body, datum), props, now, valid_from=at)


def minutes(raw: DataFrame) -> DataFrame:
    """Landed minutes (``link, gremium, datum, html``) with ``document_id`` and the parsed ``agenda``; documents without id drop out."""
    doc = F.coalesce(C("document_id"), url_parameter(C("link"), "documentId")) if "document_id" in raw.columns else url_parameter(C("link"), "documentId")
    x = raw.withColumn("document_id", doc).filter("document_id is not null").withColumn("__text", html_to_text(C("html")))
    return x.withColumns({"gremium": text_or(C("gremium"), "Unbekanntes Gremium"), "datum": F.coalesce("datum", F.lit("")), "agenda": parse_minutes(C("__text"))}).drop("__text")


def niederschriften(parsed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed minutes: the meeting, its agenda items (``agenda_of``) and decisions (``decided_in``).

    An item's ``result`` is its papers' outcome if there is only one. Of items with the same number the last
    counts; a paper's decision is keyed by its number alone.
    """
    begun = iso_time(C("datum"))
    m = emit(parsed, "Meeting", MINUTES, C("document_id"), F.concat_ws(" ", "gremium", "datum"), {"meeting_type": F.lit("protokoll"), "gremium": C("gremium"), "datum": C("datum"), "agenda_url": C("link")}, now, C("link"), valid_from=begun)
    # An outer explode: an inner one would have its filter parse each text again.
    items = parsed.select("document_id", "link", "datum", F.posexplode_outer("agenda").alias("at", "i")).filter("i is not null")
    last = items.groupBy("document_id", C("i.number").alias("number")).agg(F.max(F.struct("at", "link", "datum", "i")).alias("r")).select("document_id", "number", "r.*")
    votes = F.array_distinct(F.filter(F.transform("i.papers", lambda p: p["vote"]), lambda v: v.isNotNull()))
    sid = F.concat_ws("#", "document_id", "number")
    a = emit(last, "AgendaItem", MINUTES, sid, F.concat_ws(" ", F.lit("TOP"), "number", "i.title"), {"number": C("number"), "title": C("i.title"), "public": F.lit(None).cast("boolean"), "result": F.when(F.size(votes) == 1, votes[0])}, now, C("link"), valid_from=begun)
    papers = items.select("document_id", "link", "datum", C("i.number").alias("number"), C("i.title").alias("title"), F.explode("i.papers").alias("p"))
    one = papers.groupBy(C("p.nr").alias("nr")).agg(F.max(F.struct("datum", "document_id", "number", "title", "link", "p")).alias("r")).select("nr", "r.*")
    d = emit(one, "Resolution", MINUTES, C("nr"), F.concat(F.lit("Drucksache "), C("nr")), {"resolution_number": C("nr"), "title": C("title"), "passed": C("p.passed"), "vote": C("p.vote")}, now, C("link"), valid_from=begun)
    ident = lambda c: node_id(F.lit(MINUTES), c)
    of = relation(last.select(ident(sid).alias("from_node_id"), ident(C("document_id")).alias("to_node_id")), "RELATES_TO", "agenda_of", MINUTES, now)
    decided = relation(papers.select(ident(C("p.nr")).alias("from_node_id"), ident(F.concat_ws("#", "document_id", "number")).alias("to_node_id")).distinct(), "RELATES_TO", "decided_in", MINUTES, now)
    return m.unionByName(a).unionByName(d), of.unionByName(decided)


def oparl(raw: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Organizations, persons and meetings with their agenda and resolutions; PASSED_BY from a resolution to the meeting's committee.

    Deleted objects emit nothing. ``raw``: ``oparl_type, data`` (see the fixtures of the tests).
    """
    r = raw.filter(~F.coalesce("data.deleted", F.lit(False)))
    name = lambda default: text_or(C("data.name"), default)
    src = "council_oparl"
    party = F.get(F.filter("data.membership", lambda m: m["organization"]["classification"] == "party"), F.lit(0))["organization"]
    orgs = emit(r.filter("oparl_type = 'Organization'"), "Organization", src, C("data.id"), name("Unknown committee"), {"org_type": C("data.organizationType")}, now, C("data.id"))
    people = emit(r.filter("oparl_type = 'Person'"), "Person", src, C("data.id"), name("Unknown person"), {"role": C("data.title"), "party": F.coalesce(party["shortName"], party["name"])}, now, C("data.id"))
    met = r.filter("oparl_type = 'Meeting'")
    committee = F.get(C("data.organization"), F.lit(0))
    meetings = emit(met, "Meeting", src, C("data.id"), name("Meeting"), {"_committee_url": committee}, now, C("data.id"), valid_from=iso_time(C("data.start")), valid_to=iso_time(C("data.end")))
    items = met.select(committee.alias("committee"), F.explode("data.agendaItem").alias("i"))
    agenda = emit(items, "AgendaItem", src, C("i.id"), text_or(C("i.name"), "Agenda item"), {"number": C("i.number"), "public": F.coalesce("i.public", F.lit(True))}, now, C("i.id"))
    decided = items.select("committee", F.explode("i.resolution").alias("d"))
    resolutions = emit(decided, "Resolution", src, C("d.id"), text_or(C("d.name"), "Resolution"), {"resolution_number": C("d.resolutionNumber")}, now, C("d.id"))
    ends = decided.filter("committee is not null").select(node_id(F.lit(src), C("d.id")).alias("from_node_id"), node_id(F.lit(src), C("committee")).alias("to_node_id"))
    nodes = orgs.unionByName(people).unionByName(meetings).unionByName(agenda).unionByName(resolutions)
    return nodes, relation(ends.join(orgs.select(C("id").alias("to_node_id")), "to_node_id", "left_semi"), "PASSED_BY", None, src, now)


# Columns of election tables that are no party.
NO_PARTY = ("tag_der_wahl", "erzeugt_am", "kommune", "wahlart", "sitze_insgesamt")
PRECINCT_COLUMNS = (
    "wahltermin", "ags", "europawahlkreis", "bundestagswahlkreis_nr", "bundestagswahlkreis", "landtagswahlkreis_nr", "landtagswahlkreis", "stadtbezirk_nr", "stadtbezirk",
    "kommunalwahlbezirk_nr", "kommunalwahlbezirk", "stimmbezirk", "briefwahlbezirk", "typ", "wahlraumbezeichnung", "wahlraum_zusatz", "wahlraum", "strasse", "hausnummer",
    "zusatz", "ort", "barrierefreiheit", "geo_point_2d", "ostwert", "hochwert", "wahlberechtigte_ohne_sperrvermerk", "wahlberechtigte_mit_sperrvermerk",
    "wahlberechtigte_nicht_im_wahlerverzeichnis", "wahlberechtigte", "wahler_innen", "wahler_innen_mit_wahlschein", "ungultige_stimmen", "gultige_stimmen", "kommune",
)


def _numeric(raw: DataFrame) -> list[str]:
    return [f.name for f in raw.schema if isinstance(f.dataType, T.NumericType)]


def wide_to_map(names: dict[str, Column], zero: bool = False) -> Column:
    """Columns as a map without nulls, and without zeros unless ``zero``."""
    if not names:
        return F.create_map().cast("map<string,bigint>")
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*names.values()))
    return F.map_filter(m, lambda k, v: v.isNotNull() if zero else v.isNotNull() & (v != 0))


def wahlergebnisse(raw: DataFrame, now: Column) -> DataFrame:
    """City-wide results: party shares (``<party>_absolut``, ``<party>_in``) or seats (bare party columns)."""
    day, numbers = F.coalesce("tag_der_wahl", F.lit("")), _numeric(raw)
    seats = C("_kind") == "seats"
    parties = [c[: -len("_absolut")] for c in numbers if c.endswith("_absolut") and not c.startswith("gultige")]
    shares = wide_to_map({p: F.when(C(f"{p}_absolut").isNotNull(), F.struct(C(f"{p}_absolut").cast("long").alias("votes"), (C(f"{p}_in") if f"{p}_in" in raw.columns else F.lit(None)).cast("double").alias("pct"))) for p in parties}, zero=True)
    bare = [c for c in numbers if c not in NO_PARTY and not c.startswith("_") and not c.endswith(("_absolut", "_in")) and not c.startswith("gultige")]
    props = {
        "event_type": F.when(seats, "council_composition").otherwise("election"), "election_type": C("_type"), "tag_der_wahl": day, "tags": F.array(F.lit("wahl")),
        "party_seats": F.when(seats, wide_to_map({p: C(p).cast("long") for p in bare})), "seats_total": F.when(seats, C("sitze_insgesamt")) if "sitze_insgesamt" in raw.columns else F.lit(None).cast("int"), "party_shares": F.when(~seats, shares),
    }
    return emit(raw, "Event", "election_results", stable_id(C("_dataset"), day), F.concat_ws(" ", "_type", day), props, now, valid_from=iso_time(day))


def stimmbezirke(raw: DataFrame, now: Column) -> DataFrame:
    """Results by precinct with turnout, and the precinct's point where it is known."""
    day, nr = F.coalesce(F.nullif(C("wahltermin"), F.lit("")), C("_wahltermin")), F.coalesce("stimmbezirk", F.lit(""))
    votes = wide_to_map({c: C(c).cast("long") for c in _numeric(raw) if c not in PRECINCT_COLUMNS and not c.startswith("_")})
    kept = {c: C(c) for c in ("stadtbezirk", "stadtbezirk_nr", "kommunalwahlbezirk", "wahlberechtigte", "wahler_innen", "gultige_stimmen") if c in raw.columns}
    props = {"event_type": F.lit("election_precinct"), "wahltermin": day, "stimmbezirk": nr, **kept, "turnout_pct": share_pct(C("wahler_innen"), C("wahlberechtigte")), "party_votes": votes, "tags": F.array(F.lit("wahl"), F.lit("ratswahl"), F.lit("stimmbezirk"))}
    label = F.concat(F.lit("Ratswahl "), day, F.lit(" Stimmbezirk "), nr, F.lit(" ("), F.coalesce("stadtbezirk", F.lit("None")), F.lit(")"))
    return emit(raw, "Event", "election_precincts", stable_id(C("_dataset"), nr), label, props, now, valid_from=iso_time(day), lat=C("geo_point_2d.lat"), lon=C("geo_point_2d.lon"))
