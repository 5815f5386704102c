"""Schemas of the decoded input tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "roster_cells": "scan_id string, row int, col int, val string",
    "gt_lines": "scan_id string, line_no long, line string",
    "files": "folder string, name string, mtime timestamp, size long",
    "exam_pages": "exam_id string, page int, w double, h double",
    "text_lines": ("exam_id string, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, "
                   "font_size double, text string, spans array<struct<text:string,x0:double,x1:double>>"),
    "drawings": "exam_id string, page int, x0 double, y0 double, x1 double, y1 double, kind string",
    "questions": ("exam_id string, node_id string, parent_id string, depth int, path array<int>, number string, "
                  "question_type string, text string, marks int, "
                  "bbox struct<x0:double,y0:double,x1:double,y1:double,page:int>, correct_answer string, "
                  "marking_criteria string, answer_options array<struct<letter:string,text:string>>"),
    "raster_rows": "scan_id string, page int, dpi int, y int, w int, px binary",
    "page_meta": "scan_id string, page int, w int, h int, rotate int, osd_rotate int, osd_conf double",
    "anchor_candidates": ("scan_id string, page int, half string, side string, x int, y int, tw int, th int, "
                          "score double"),
    "anchors": "scan_id string, page int, quadrant string, x double, y double, score double",
    "page_reads": ("scan_id string, page int, kind string, student string, q_number string, pass int, raw string"),
    "instructions": "request_id string, prompt string, raw string",
    "engine_reads": ("scan_id string, page int, engine string, config int, text string, conf double, ms double"),
}


def schema(name: str) -> StructType:
    """Schema of an input table; unknown names raise."""
    if name not in _DDL:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(sorted(_DDL))}")
    return StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return list(_DDL)
