"""Errors. Wrong configurations raise on the driver; what is wrong with a row becomes its error column."""


class TreeloomError(Exception):
    """Base of all errors here."""


class LanguageNotFound(TreeloomError):
    def __init__(self, name: str):
        super().__init__(f"language not found: {name}")
        self.name = name


class ParserSetup(TreeloomError):
    pass


class ConfigError(TreeloomError):
    pass


class ParseFailed(TreeloomError):
    pass


class QueryError(TreeloomError):
    pass


class InvalidRange(TreeloomError):
    pass


class DownloadError(TreeloomError):
    pass


class IoError(ConfigError):
    """A file can't be read or written."""


class TomlError(ConfigError):
    """A configuration file isn't TOML."""


class JsonError(ConfigError):
    """A configuration given as text isn't JSON."""


class ChecksumMismatch(DownloadError):
    def __init__(self, file: str, expected: str, actual: str):
        super().__init__(f"checksum mismatch for {file}: expected {expected}, got {actual}")
        self.file, self.expected, self.actual = file, expected, actual
