"""What can go wrong, as exceptions; in tables it is the code of a row."""

from __future__ import annotations


class WeftlineError(Exception):
    code = "ERROR"


class FetchError(WeftlineError):
    code = "FETCH_ERROR"


class RobotsError(WeftlineError):
    code = "ROBOTS_ERROR"


class ParseError(WeftlineError):
    code = "PARSE_ERROR"


class ExtractionError(WeftlineError):
    code = "EXTRACTOR_ERROR"
