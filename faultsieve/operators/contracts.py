"""The contracts of model replies as JSON Schema texts; `functions.schema` compiles them, nothing else knows their rules."""

# The fields of an explanation, their types and its confidence levels.
EXPLANATION_SCHEMA = """{
  "type": "object", "additionalProperties": false,
  "required": ["summary", "root_cause", "evidence", "failing_module", "explanation_confidence", "limitations"],
  "properties": {
    "summary": {"type": "string", "minLength": 1}, "root_cause": {"type": "string", "minLength": 1}, "evidence": {"type": "array", "items": {"type": "string", "minLength": 1}},
    "failing_module": {"type": ["string", "null"]}, "explanation_confidence": {"type": "string", "enum": ["high", "medium", "low"]}, "limitations": {"type": "string", "minLength": 1}
  }
}"""

# The fields of a fix and of its evidence. An install has no version, a pin has one, and none has neither name nor command.
FIX_SCHEMA = """{
  "type": "object", "additionalProperties": false,
  "required": ["action", "import_name", "install_name", "version", "command", "rationale", "pypi_evidence"],
  "$defs": {"text": {"type": "string", "minLength": 1}, "maybe": {"type": ["string", "null"]}, "gap": {"type": "null"}},
  "properties": {
    "action": {"enum": ["install", "pin_version", "none"]}, "import_name": {"$ref": "#/$defs/text"}, "install_name": {"$ref": "#/$defs/maybe"}, "version": {"$ref": "#/$defs/maybe"},
    "command": {"type": ["string", "null"], "pattern": "^pip install [^ ]+$"}, "rationale": {"$ref": "#/$defs/text"},
    "pypi_evidence": {
      "type": "object", "additionalProperties": false, "required": ["latest_version", "chosen_version", "requires_python"],
      "properties": {"latest_version": {"$ref": "#/$defs/maybe"}, "chosen_version": {"$ref": "#/$defs/maybe"}, "requires_python": {"$ref": "#/$defs/maybe"}}
    }
  },
  "allOf": [
    {"if": {"properties": {"action": {"const": "install"}}}, "then": {"properties": {"install_name": {"$ref": "#/$defs/text"}, "version": {"$ref": "#/$defs/gap"}, "command": {"$ref": "#/$defs/text"}}}},
    {"if": {"properties": {"action": {"const": "pin_version"}}}, "then": {"properties": {"install_name": {"$ref": "#/$defs/text"}, "version": {"$ref": "#/$defs/text"}, "command": {"$ref": "#/$defs/text"}}}},
    {"if": {"properties": {"action": {"const": "none"}}}, "then": {"properties": {"install_name": {"$ref": "#/$defs/gap"}, "version": {"$ref": "#/$defs/gap"}, "command": {"$ref": "#/$defs/gap"}}}}
  ]
}"""
