"""A store of ringed birds: loading, lineage, saved specs, versions and what keeps them."""

import datetime as dt
import pathlib

import pytest

from siftwell import Refused, SpecError
from siftwell.sources.store import Store, relation_name

SEEN = "ring,species,grams\n" + "".join(
    f"{'' if i == 4 else f'0{i % 6:03d}'},{'wren' if i % 2 else 'robin'},{9 + i}\n" for i in range(8))
STATIONS = "station,ring\n" + "".join(f"{s},0{i:03d}\n" for i, s in enumerate(("Fen", "Moor", "Moor", "Quay")))
AT_ONCE = dt.timedelta(seconds=-5)


def cut(relation, *columns, **more):
    return {"mode": "slice", "relation": relation, **({"columns": list(columns)} if columns else {}), **more}


@pytest.fixture
def birds(spark, tmp_path, csv_file):
    """A store with one source, and a way to load a CSV into it."""
    held = Store(spark, str(tmp_path / "birds"))
    held.put = lambda name, text, **more: held.load(csv_file(f"{name}.csv", text), **more)
    held.put("seen", SEEN, owner="kit")
    return held


def about(store, column):
    return {r["name"]: r[column] for r in store.relations().collect()}


@pytest.mark.parametrize("label, name", [("Ringing Log (3).csv", "ringing_log_3"), ("C:\\logs\\Nest-Box.CSV", "nest_box"),
                                         ("1999 moor.csv", "s_1999_moor"), ("/shared/log/", "log")])
def test_a_label_gives_a_stable_name(label, name):
    assert relation_name(label) == name


@pytest.mark.parametrize("label", ["", "...", "//", "?!.csv"])
def test_a_label_without_letters_or_digits_is_refused(label):
    with pytest.raises(SpecError):
        relation_name(label)


def test_rings_keep_their_zeros_and_gaps_stay_gaps(birds):
    rings = [r["ring"] for r in birds.table("seen").orderBy("grams").collect()]
    assert rings == ["0000", "0001", "0002", "0003", None, "0005", "0000", "0001"]
    assert about(birds, "owner") == {"seen": "kit"}


def test_staleness_travels_down_a_chain_of_three(birds):
    birds.save(birds.query(cut("seen", "ring", "grams")), "weights")
    birds.save(birds.query(cut("weights", "ring")), "ringed")
    birds.save(birds.query({"mode": "pivot", "relation": "ringed", "rows": ["ring"], "value": "ring", "agg": "count"}), "visits")
    assert set(about(birds, "staleness").values()) == {"fresh"}
    assert {r["name"] for r in birds.dependents("weights").collect()} == {"ringed", "visits"}
    assert {r["name"] for r in birds.reload_impact("seen").turns_stale.collect()} == {"weights", "ringed", "visits"}
    assert birds.reload_impact("unheard").already_loaded is False
    birds.put("seen", SEEN.replace("wren", "dunnock"))
    assert about(birds, "staleness") == {"seen": "fresh", "weights": "stale", "ringed": "stale", "visits": "stale"}
    notes = about(birds, "note")
    assert notes["weights"] == "seen changed after this was cut"
    assert notes["visits"] == "ringed is stale itself, as seen changed"
    for name, source in (("weights", "seen"), ("ringed", "weights")):
        birds.save(birds.query(cut(source, "ring", "grams") if name == "weights" else cut(source, "ring")), name)
    assert about(birds, "staleness")["ringed"] == "fresh" and about(birds, "staleness")["visits"] == "stale"


def test_nothing_is_claimed_of_hand_written_sql(birds):
    birds.save(birds.query({"mode": "sql", "sql": "SELECT species, max(grams) AS top FROM seen GROUP BY species"}), "tops")
    assert about(birds, "staleness")["tops"] == "unknown" and about(birds, "inputs")["tops"] == []


def test_a_growing_join_is_confirmed_and_remembers_both_sides(birds):
    birds.put("stations", STATIONS.replace("Quay,0003", "Quay,0001"))
    spec = {"mode": "join", "join": {"inputs": [
        {"relation": "seen", "alias": "s", "columns": ["species"]},
        {"relation": "stations", "alias": "t", "columns": ["station"],
         "join": {"type": "left", "with": "s", "on": [["ring", "ring"]]}}]}}
    with pytest.raises(Refused):
        birds.query(spec)
    assert birds.save(birds.query(spec, confirm=True), "where seen") == 10     # 0001 was seen twice, at two stations
    assert about(birds, "inputs")["where_seen"] == ["seen", "stations"] and about(birds, "base")["where_seen"] == "seen"
    assert birds.drop("stations") == ["where_seen"]
    assert about(birds, "staleness")["where_seen"] == "unknown"


def test_sources_and_slices_do_not_take_each_others_names(birds):
    birds.save(birds.query(cut("seen")), "copy")
    with pytest.raises(SpecError):
        birds.save(birds.query(cut("copy")), "seen")
    with pytest.raises(SpecError):
        birds.put("copy", STATIONS)


def test_a_saved_spec_runs_on_todays_rows(birds):
    birds.save_query("  heavy   birds ", cut("seen", "species", filters={"kind": "cond", "column": "grams", "op": ">", "value": 13},
                                             page=2, page_size=1, confirm=True))
    kept, = birds.saved_queries()
    assert (kept["name"], kept["inputs"]) == ("heavy birds", ["seen"])
    assert not {"page", "page_size", "confirm"} & set(kept["spec"])
    assert birds.run_saved("heavy birds").rows.count() == 3
    birds.put("seen", SEEN + "0009,owl,400\n")
    assert birds.run_saved("heavy birds").rows.count() == 4
    birds.put("seen", "ring,species\n0001,owl\n")
    with pytest.raises(SpecError, match="heavy birds.*grams"):
        birds.run_saved("heavy birds")


@pytest.mark.parametrize("name, spec", [
    ("counts", {"mode": "frequencies", "relation": "seen", "column": "ring"}), ("look", {"mode": "preview", "relation": "seen"}),
    ("odd", {"mode": "waltz"}), ("", cut("seen")), ("gone", cut("unheard")), ("strange", cut("seen", "wingspan"))])
def test_what_cannot_be_kept_is_not(birds, name, spec):
    with pytest.raises(SpecError):
        birds.save_query(name, spec)
    assert birds.saved_queries() == []


def test_rejects_belong_to_one_load(birds):
    assert birds.put("seen", SEEN + "0001\n0002,wren,5,6,7\n0003,wren\n").rejected_lines == 3
    assert birds.count_rejects("seen") == birds.rejects("seen").total == 5    # one for each field too few or too many
    cutoff = birds.rejects("seen", 2)
    assert cutoff.truncated and cutoff.rows.count() == 2
    assert not birds.put("seen", SEEN).rejected and birds.count_rejects("seen") == 0
    with pytest.raises(SpecError):
        birds.rejects("unheard")


def files_of(store):
    return sum(1 for p in pathlib.Path(store.root).rglob("slices/**/*.parquet"))


def test_a_snapshot_copies_no_rows_and_keeps_what_it_names(birds, tmp_path):
    birds.save(birds.query(cut("seen", "species")), "kinds")
    before, old = files_of(birds), birds.paths()["kinds"]
    stamp = birds.snapshot()
    listed, = birds.snapshots()
    assert listed["name"] == stamp and listed["files"] and listed["bytes"] and files_of(birds) == before + 1    # its registry
    birds.save(birds.query(cut("seen", "species", filters={"kind": "cond", "column": "species", "op": "=", "value": "wren"})), "kinds")
    assert birds.vacuum(AT_ONCE) == []
    held = {r["path"]: r["held_by"] for r in birds.references().collect()}
    assert held[old] == [f"snapshot {stamp}"] and held[birds.paths()["kinds"]] == [birds.root]
    back = birds.restore(stamp, str(tmp_path / "again"))
    assert back.table("kinds").count() == 8 and birds.table("kinds").count() == 4
    assert about(back, "staleness") == {"seen": "fresh", "kinds": "fresh"}
    birds.drop_snapshot(stamp)
    assert birds.snapshots() == [] and birds.vacuum(AT_ONCE) == []      # the restored store still reads it
    assert back.table("kinds").count() == 8
    back.drop("kinds")
    assert birds.vacuum(AT_ONCE) == [old] and birds.table("kinds").count() == 4


def test_vacuum_spares_the_young_and_the_current(birds):
    first = birds.paths()["seen"]
    birds.put("seen", SEEN + "0009,owl,400\n")
    assert birds.vacuum() == []
    gone = birds.vacuum(AT_ONCE)
    assert first in gone and birds.paths()["seen"] not in gone and birds.table("seen").count() == 9


@pytest.mark.parametrize("stamp", ["", "20000101-000000-000000", "../slices"])
def test_unknown_snapshots_are_refused(birds, tmp_path, stamp):
    for attempt in (lambda: birds.restore(stamp, str(tmp_path / "x")), lambda: birds.drop_snapshot(stamp)):
        with pytest.raises(SpecError):
            attempt()


def test_restoring_over_a_store_is_refused(birds):
    with pytest.raises(SpecError):
        birds.restore(birds.snapshot(), birds.root)


def test_previews_say_what_they_show(birds):
    first = birds.query({"mode": "preview", "relation": "seen", "page_size": 3})
    assert [r["grams"] for r in first.rows.collect()] == [9, 10, 11]
    assert first.preview == {"kind": "head", "size": 3, "of": 8, "seed": None, "order": "stored"}
    draws = [birds.query({"mode": "preview", "relation": "seen", "preview": "sample", "seed": s, "page_size": 5}) for s in (2, 2)]
    assert draws[0].rows.collect() == draws[1].rows.collect() and draws[0].preview["seed"] == 2
    with pytest.raises(SpecError):
        birds.query({"mode": "preview", "relation": "seen", "preview": "middle"})


def test_a_query_turns_its_own_pages(birds):
    query = birds.query(cut("seen", "species", "grams", sort="grams", desc=True, page_size=5))
    pages = [query.page(), query.page(2)]
    assert [p.rows.count() for p in pages] == [5, 3] and {(p.total, p.pages) for p in pages} == {(8, 2)}
    assert pages[1].rows.first()["grams"] == 11
