"""Errors of the engine by reason."""

from __future__ import annotations


class OntoweaveError(Exception):
    reason = "Error"


def _kind(name: str, base=OntoweaveError, **named):
    return type(name, (base,), {"reason": name.removesuffix("Error"), "__module__": __name__, **named})


ParseError = _kind("ParseError")
GraphCycleError = _kind("GraphCycleError")
MissingNodeDataError = _kind("MissingNodeDataError")
InheritanceError = _kind("InheritanceError")
CircularInheritanceError = _kind("CircularInheritanceError", InheritanceError)
DisjointnessCheckError = _kind("DisjointnessCheckError")
MeetError = _kind("MeetError")
EmptyVocabularyError = _kind("EmptyVocabularyError")
ExtractionError = _kind("ExtractionError")
RdfError = _kind("RdfError")
ShaclError = _kind("ShaclError")
NlpError = _kind("NlpError")
ChunkingError = _kind("ChunkingError")
MetadataError = _kind("MetadataError")
CheckpointError = _kind("CheckpointError")
LoadError = _kind("LoadError")
EvaluationError = _kind("EvaluationError")
RunError = _kind("RunError")
