"""What can go wrong, as exceptions. Those that depend on the data surface when a plan runs, with the same names in the text."""


class BinloomError(ValueError):
    """Base of all errors of the library."""


class CreationError(BinloomError):
    """A geometry that can't be made."""


class LowIsZero(CreationError):
    pass


class LowExceedsMax(CreationError):
    pass


class HighLessThanTwiceLow(CreationError):
    pass


class SigFigExceedsMax(CreationError):
    pass


class CannotRepresentSigFigBeyondLow(CreationError):
    pass


class RecordError(BinloomError):
    pass


class ValueOutOfRange(RecordError):
    pass


class AdditionError(BinloomError):
    pass


class OtherAddendValueExceedsRange(AdditionError):
    pass


class SubtractionError(BinloomError):
    pass


class SubtrahendValueExceedsMinuendRange(SubtractionError):
    pass


class SubtrahendCountExceedsMinuendCount(SubtractionError):
    pass


class SerializeError(BinloomError):
    pass


class CountNotSerializable(SerializeError):
    pass


class DeserializeError(BinloomError):
    pass


class InvalidCookie(DeserializeError):
    pass


class UnsupportedFeature(DeserializeError):
    pass


class UnsuitableCounterType(DeserializeError):
    pass


class InvalidParameters(DeserializeError):
    pass


class EncodedArrayTooLong(DeserializeError):
    pass


class Truncated(DeserializeError):
    pass


class LogError(BinloomError):
    pass


class MaxValueNotFormattable(LogError):
    pass


class ParseError(LogError):
    def __init__(self, offset: int):
        super().__init__(f"ParseError at byte {offset}")
        self.offset = offset
