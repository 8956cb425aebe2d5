"""Table contracts of catalog stores.

Column names are fixed values. Types are given where the stores' own definitions state them
(``library``, ``entity.identity``, ``entity.reconciliation_log``); elsewhere they are our choice:
ids and counts are long, texts are string, times are timestamp.
"""

from __future__ import annotations

from pyspark.sql import types as T

LIBRARY = {
    "library": "id int, title string, artist string, call_letters string, artist_call_number int, release_call_number int, genre string, format string, alternate_artist_name string",
}
#: Fixed values.
LIBRARY_FTS_TABLE = "library_fts"
LIBRARY_FTS_COLUMNS = ("title", "artist", "alternate_artist_name")

ENTITY = {
    "entity.identity": "id int, library_name string, discogs_artist_id int, wikidata_qid string, musicbrainz_artist_id string, spotify_artist_id string, apple_music_artist_id string, bandcamp_id string, reconciliation_status string, created_at timestamp, updated_at timestamp",
    "entity.reconciliation_log": "id int, identity_id int, source string, external_id string, confidence float, method string, created_at timestamp",
}

DISCOGS = {
    "release": "id long, title string, release_year short, country string, artwork_url string, released string, format string, master_id long",
    "release_artist": "release_id long, artist_id long, artist_name string, extra int, role string",
    "release_label": "release_id long, label_id long, label_name string, catno string",
    "release_genre": "release_id long, genre string",
    "release_style": "release_id long, style string",
    "release_track": "release_id long, sequence int, position string, title string, duration string",
    "release_track_artist": "release_id long, track_sequence int, artist_name string",
    "artist": "id long, name string, profile string, image_url string, fetched_at timestamp",
    "artist_alias": "artist_id long, alias_id long, alias_name string",
    "artist_name_variation": "artist_id long, name string",
    "artist_member": "artist_id long, member_id long, member_name string, active boolean",
    "artist_url": "artist_id long, url string",
    "cache_metadata": "release_id long, cached_at timestamp, source string, last_validated timestamp",
}

MUSICBRAINZ = {
    "mb_area_type": "id long, name string",
    "mb_gender": "id long, name string",
    "mb_tag": "id long, name string",
    "mb_area": "id long, name string, type long",
    "mb_country_area": "area long",
    "mb_artist": "id long, name string, sort_name string, type long, area long, gender long, begin_area long, comment string",
    "mb_artist_alias": "id long, artist long, name string, sort_name string, locale string, type long, primary_for_locale boolean",
    "mb_artist_tag": "artist long, tag long, count long",
    "mb_artist_credit": "id long, name string, artist_count int",
    "mb_artist_credit_name": "artist_credit long, position int, artist long, name string, join_phrase string",
    "mb_release_group": "id long, name string, artist_credit long, type long",
    "mb_recording": "id long, gid string, name string, artist_credit long, length long",
    "mb_medium": "id long, release long, position int, format long",
    "mb_track": "id long, recording long, medium long, position int, name string, artist_credit long, length long",
}

WIKIDATA = {
    "entity": "qid string, label string, description string, entity_type string",
    "discogs_mapping": "qid string, property string, discogs_id string",
    "influence": "source_qid string, target_qid string",
    "genre": "entity_qid string, genre_qid string",
    "record_label": "artist_qid string, label_qid string",
    "label_hierarchy": "child_qid string, parent_qid string",
    "entity_alias": "qid string, alias string",
    "occupation": "entity_qid string, occupation_qid string",
}

GROUPS = {"library": LIBRARY, "entity": ENTITY, "discogs": DISCOGS, "musicbrainz": MUSICBRAINZ, "wikidata": WIKIDATA}


def tables(group: str) -> list[str]:
    return list(GROUPS[group])


def struct(group: str, table: str) -> T.StructType:
    return T.StructType.fromDDL(GROUPS[group][table])


def columns(group: str, table: str) -> list[str]:
    return [c.split()[0] for c in GROUPS[group][table].split(", ")]


def create_table(group: str, table: str, using: str = "parquet") -> str:
    """Spark SQL for the table; a schema before the name is made part of it."""
    return f"CREATE TABLE IF NOT EXISTS `{table.replace('.', '_')}` ({GROUPS[group][table]}) USING {using}"


#: For the SQLite writer.
#: The columns.
LIBRARY_DDL = (
    "CREATE TABLE library (id INTEGER PRIMARY KEY, title TEXT, artist TEXT, call_letters TEXT, artist_call_number INTEGER, "
    "release_call_number INTEGER, genre TEXT, format TEXT, alternate_artist_name TEXT)"
)
