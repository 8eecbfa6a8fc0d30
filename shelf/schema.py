"""Schemas of the relations; nothing is inferred."""

from __future__ import annotations

PLACE = "struct<country:string,region:string,city:string>"
RECORD = (
    "rel_path string, size long, kind string, taken timestamp_ntz, date_source string, "
    "gps struct<lat:float,lon:float>, offset_time string, camera_make string, camera_model string, "
    "signature_ok boolean"
)
EXTRACT = RECORD + ", digest string, error string"
LISTING = "path string, size long, is_dir boolean, digest string"
JOURNAL = "source string, destination string"
GAZETTEER = "ord long, lat float, lon float, cc string, region string, name string"
OPERATION = "pos long, source_rel string, dest_rel string, action string, reason string, bytes long, duplicate_of string"
OUTCOME = OPERATION + ", error string, attempted boolean"
