"""Names, thresholds and types that all parts share."""

from __future__ import annotations

DIRECTIONS = ("machine", "human", "neutral")
LABELS = ("leans-machine", "leans-human", "mixed-signals", "uncertain", "no-evidence")
SCHEMA_VERSION = "1"
#: Code points of context kept on each side of a span.
CONTEXT = 40

# The thresholds of scoring.
LEAN_THRESHOLD = 0.45
STRENGTH_FLOOR = 0.20
EVIDENCE_FULL = 1.5
REFERENCE_CHARS = 1000
SEGMENT_RATE_FULL = 0.35
PER_WORDS = 1000

#: A piece of evidence. The first five fields are its place in a segment's order.
SIGNAL = "struct<at:int,name:string,d:int,longer:int,ord:int,direction:string,weight:double,detector:string,value:string,note:string,start:int,end:int,matched:string,level:string>"
SIGNALS = f"array<{SIGNAL}>"
SEGMENT = "struct<start:int,end:int,quote:string,prefix:string,suffix:string,level:string>"
#: A reader's judgment on a document.
JUDGMENT = "struct<direction:string,quote:string,start:int,end:int,name:string,weight:double,note:string,detector:string,value:string>"
