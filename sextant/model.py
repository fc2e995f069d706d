"""Schemas and fixed names of the content index."""

from __future__ import annotations

# Content graphs, their element classes and a mime type of each.
GRAPHS = ("Documents", "Pictures", "Audio", "Video", "Software")
CLASSES = ("nfo:Document", "nfo:Image", "nmm:MusicPiece", "nfo:Video", "nfo:Software")
MIMES = ("text/plain", "image/png", "audio/mpeg", "video/mp4", "application/x-desktop")
FILE_GRAPH = "FileSystem"

SCHEMAS = {
    "files": "uri string, container_urn string, file_name string, size long, mtime timestamp, atime timestamp, ctime timestamp, data_source string, extractor_hash string, interpreted_as string, mime string",
    "volumes": "urn string, root_uri string, available boolean, is_removable boolean, is_optical boolean, unmount_date timestamp",
    "elements": "urn string, graph string, rdf_types array<string>, stored_as string, title string, mime string, plain_text string, keywords array<string>, props map<string,string>",
    "tags": "urn string, label string, description string",
    "tag_edges": "subject string, tag_urn string",
    "channels": "urn string, url string, title string, update_interval int",
    "messages": "urn string, url string, channel string, title string, published timestamp, html string, is_read boolean",
    "monitor_events": "ts timestamp, seq long, path string, other_path string, kind string, is_dir boolean",
    "quads": "g string, s string, p string, o string, o_type string",
    "errors": "key string, uri string, message string, sparql string",
}
