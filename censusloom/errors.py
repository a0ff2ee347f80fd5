"""Errors a job raises for inputs it cannot give a right answer for."""


class SurveyError(RuntimeError):
    """The input breaks a contract: columns, labels, population or parameters."""


def check(condition: bool, message: str) -> None:
    """Raise :class:`SurveyError` with ``message`` unless ``condition`` holds."""
    if not condition:
        raise SurveyError(message)
