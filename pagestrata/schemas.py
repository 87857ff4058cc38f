"""Schemas of the archive's tables."""

from __future__ import annotations

CAPTURES = (
    "capture_id string, warc_record_id string, segment string, offset long, length long, url string, url_key string, url_key_rules string, intent string, route_key string, "
    "surface string, verdict string, capture_fidelity string, observed_at string, http_status int, content_type string, content_sha256 string, verdict_reason string, "
    "parent_capture_id string, cursor struct<kind:string,value:bigint>, item_count int, item_time_range struct<oldest:string,newest:string>, note string"
)
SEGMENT = "struct<filename:string,bytes:bigint,sha256:string,record_count:bigint,first_capture_id:string,last_capture_id:string>"
STATE = (
    "struct<route_key:string,intent:string,high_water_time:string,high_water_raw:string,high_water_ids:array<string>,low_water_time:string,low_water_raw:string,floor_time:string,"
    "floor_from_bundle_id:string,enumeration:string,contiguous:boolean,gaps:array<struct<reason:string,detail:string>>,advanced:boolean,completed_at:string>"
)
COVERAGE = "struct<route_key:string,intent:string,claimed_count:int,claimed_raw:string,claimed_source:string,claimed_observed_at:string,captured_count:bigint,delta:bigint>"
MANIFEST = (
    "bundle_id string, previous_bundle_id string, status string, created_at string, completed_at string, account struct<user_id:string,username:string>, "
    f"segments array<{SEGMENT}>, index struct<filename:string,sha256:string,line_count:bigint>, crawl_state array<{STATE}>, coverage array<{COVERAGE}>"
)
FILES = "bundle_id string, side string, name string, bytes long, sha256 string"
EVENTS = "at string, type string, route_key string, verdict string, reason string, url string, message string"
# rows of content extractors, and the definition of a route
MARK = "title string, date string, rating string, tags array<string>, comment string"
BROADCAST = "target_title string, action string, posted_at string, rating string, text string"
LONG_FORM = "title string, published_at string, location string, body string"
LIST = "id string, title string, visibility string, items array<struct<title:string,comment:string,entry_id:string,upstream_id:string>>"
ROUTE = (
    "key string, intent string, kind string, surface string, priority int, source string, enumeration string, safety_net string, "
    "pagination struct<kind:string,step:int,first:int>, ordered boolean, requires array<string>, template string"
)
