"""Exceptions and warnings of the validators."""


class FrameError(ValueError):
    """A frame doesn't have the asked columns or types."""


class MeaningError(ValueError):
    """Values contradict what the columns mean."""


class UnitError(MeaningError):
    """Declared units are not the project's."""


class AlignmentNotice(UserWarning):
    """Two tables lie further apart in time than tolerated."""
