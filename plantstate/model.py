"""Schemas and fixed names of the entity, attribute, triple and constraint tables."""

from __future__ import annotations

#: Names that the tables use.
NGSI = "https://uri.etsi.org/ngsi-ld/"
PROPERTY, RELATIONSHIP, JSON_PROPERTY, LIST_PROPERTY, GEO_PROPERTY = (NGSI + x for x in ("Property", "Relationship", "JsonProperty", "ListProperty", "GeoProperty"))
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
RDF_FIRST = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#first>"
RDF_REST = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>"
RDF_NIL = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#nil>"
RDF_MEMBER = "<http://www.w3.org/2000/01/rdf-schema#member>"
SUBCLASS = "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
SUBPROPERTY = "<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>"
DOMAIN = "<http://www.w3.org/2000/01/rdf-schema#domain>"
RANGE = "<http://www.w3.org/2000/01/rdf-schema#range>"
TRANSITIVE = "<http://www.w3.org/2002/07/owl#TransitiveProperty>"
CLASS = "<http://www.w3.org/2002/07/owl#Class>"

ENTITIES = "id string, type string, deleted boolean, ts timestamp"
ATTRIBUTES = "id string, parentId string, entityId string, name string, nodeType string, valueType string, type string, attributeValue string, datasetId string, unitCode string, lang string, deleted boolean, synced boolean, ts timestamp"
RDF = "subject string, predicate string, object string, index int"
CONSTRAINT_COLUMNS = ("targetClass", "propertyPath", "subpropertyPath", "propertyClass", "propertyNodetype", "attributeType", "maxCount", "minCount", "severity", "minExclusive", "maxExclusive", "minInclusive", "maxInclusive", "minLength", "maxLength", "pattern", "ins", "datatypes", "hasValue")
CONSTRAINTS = "id int, " + ", ".join(f"{c} string" for c in CONSTRAINT_COLUMNS)
COMBINATIONS = "member_constraint_id int, operation string, target_constraint_id int"
TRIGGERS = "resource string, event string, constraint_id int, triggered boolean, severity string, text string"
ALERTS = "resource string, event string, environment string, service array<string>, severity string, customer string, text string"
TELEMETRY = "timestamp bigint, seq int, metrics array<struct<name:string,alias:string,timestamp:bigint,dataType:string,value:string,properties:struct<keys:array<string>,values:array<string>>>>"
