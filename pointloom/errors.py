"""What can go wrong, as exceptions."""


class PointError(Exception):
    """Base of all errors of this package."""


class Cancelled(PointError): ...


class UnsupportedFormat(PointError): ...


class CoordinateSystemMismatch(PointError): ...


class IncompatibleMetadata(PointError): ...


class NoOverlap(PointError): ...


class AlignmentUndetermined(PointError): ...


class TooFewPairs(PointError): ...


class InvalidState(PointError): ...


class TargetExists(PointError): ...


class ProjectLocked(PointError): ...
