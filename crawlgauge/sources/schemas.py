"""Schemas of the input and output tables."""

from __future__ import annotations

PAGES = "page_id bigint, url string, html string"

SCAN_REQUESTS = "scan_id bigint, url string, ord int"

RESOURCES = (
    "scan_id bigint, site_url string, path string, status int, final_url string, "
    "headers map<string,string>, body string, error string, fetched_at timestamp"
)
# Resources as a crawler streams them: each carries the start of its scan.
ARRIVING = RESOURCES + ", started_at timestamp"

FINDING = (
    "struct<check_idx:int,key:string,label:string,status:string,reason:string,"
    "points_earned:int,points_max:int,points_lost:int,detail:string,action:string,"
    "effort_level:string,effort_time:string>"
)
