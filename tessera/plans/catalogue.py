"""Clauses that come with each known kind of dataset, and what a contract learned from data gets on top."""

from __future__ import annotations

import yaml

from tessera.plans.contract import Clause, Contract

# The clauses of each kind of dataset. Reports and baselines are keyed by these ids, so they must agree.
CLAUSES = r"""
intents:
  - {id: week1.intent_id_uuid, rule: {type: field_format, field: intent_id, format: uuid}}
  - {id: week1.created_at_datetime, rule: {type: field_format, field: created_at, format: date-time}}
  - {id: week1.code_refs_non_empty, rule: {type: array_min_items, field: code_refs, minimum: 1}}
  - {id: week1.code_ref_confidence_unit_scale, rule: {type: numeric_range, field: code_refs.confidence, minimum: 0, maximum: 1}}
  - {id: week1.code_ref_file_exists, rule: {type: repo_path_exists, field: code_refs.file}}
verdicts:
  - {id: week2.verdict_id_uuid, rule: {type: field_format, field: verdict_id, format: uuid}}
  - {id: week2.overall_verdict_enum, rule: {type: field_enum, field: overall_verdict, allowed: [PASS, FAIL, WARN]}}
  - {id: week2.score_range, rule: {type: numeric_range, field: scores.score, minimum: 1, maximum: 5}}
  - {id: week2.overall_score_weighted_mean, rule: {type: weighted_mean_equals, map_field: scores, output: overall_score, tolerance: 0.001}}
  - {id: week2.rubric_id_sha256, rule: {type: field_pattern, field: rubric_id, pattern: '[0-9a-f]{64}$'}}
  - {id: week2.rubric_version_semver, rule: {type: field_pattern, field: rubric_version, pattern: '\d+\.\d+\.\d+$'}}
  - {id: week2.confidence_unit_scale, rule: {type: numeric_range, field: confidence, minimum: 0, maximum: 1}}
  - {id: week2.evaluated_at_datetime, rule: {type: field_format, field: evaluated_at, format: date-time}}
extractions:
  - {id: week3.doc_id_uuid, rule: {type: field_format, field: doc_id, format: uuid}}
  - {id: week3.extracted_at_datetime, rule: {type: field_format, field: extracted_at, format: date-time}}
  - {id: week3.fact_id_uuid, rule: {type: field_format, field: extracted_facts.fact_id, format: uuid}}
  - {id: week3.confidence_unit_scale, rule: {type: numeric_range, field: extracted_facts.confidence, minimum: 0, maximum: 1}}
  - {id: week3.page_ref_positive, rule: {type: numeric_range, field: extracted_facts.page_ref, minimum: 1}}
  - {id: week3.source_excerpt_present, rule: {type: string_length, field: extracted_facts.source_excerpt, minimum: 1}}
  - {id: week3.source_hash_sha256, rule: {type: field_pattern, field: source_hash, pattern: '[0-9a-f]{64}$'}}
  - {id: week3.extraction_rules_hash_sha256, rule: {type: field_pattern, field: extraction_rules_hash, pattern: '[0-9a-f]{64}$'}}
  - {id: week3.processing_time_positive, rule: {type: numeric_range, field: processing_time_ms, minimum: 1}}
  - {id: week3.source_path_lineage, severity: warn, rule: {type: field_pattern, field: source_path, pattern: '.*/(artifacts/)?week3/.refinery/(extracted|chunks)/.+'}}
  - {id: week3.token_counts_non_negative, severity: warn, rule: {type: multi_field_numeric_range, fields: [token_count.input, token_count.output], minimum: 0}}
lineage:
  - {id: week4.snapshot_id_uuid, rule: {type: field_format, field: snapshot_id, format: uuid}}
  - {id: week4.git_commit_sha1, rule: {type: field_pattern, field: git_commit, pattern: '[0-9a-f]{40}$'}}
  - {id: week4.edge_relationship_enum, rule: {type: field_enum, field: edges.relationship, allowed: [IMPORTS, CALLS, READS, WRITES, PRODUCES, CONSUMES]}}
  - {id: week4.edge_endpoints_exist, rule: {type: edge_endpoints_exist, nodes: nodes, edges: edges}}
  - {id: week4.edge_confidence_unit_scale, rule: {type: numeric_range, field: edges.confidence, minimum: 0, maximum: 1}}
  - {id: week4.captured_at_datetime, rule: {type: field_format, field: captured_at, format: date-time}}
events:
  - {id: week5.event_id_uuid, rule: {type: field_format, field: event_id, format: uuid}}
  - {id: week5.aggregate_id_uuid, rule: {type: field_format, field: aggregate_id, format: uuid}}
  - {id: week5.aggregate_type_enum, rule: {type: field_enum, field: aggregate_type, allowed: [LoanApplication, AgentSession, DocumentPackage, ComplianceRecord, AuditLedger]}}
  - {id: week5.event_type_pascal_case, rule: {type: field_pattern, field: event_type, pattern: '[A-Z][A-Za-z0-9]*$'}}
  - {id: week5.occurred_at_datetime, rule: {type: field_format, field: occurred_at, format: date-time}}
  - {id: week5.recorded_at_not_before_occurred_at, rule: {type: temporal_order, left: occurred_at, right: recorded_at, operator: '<='}}
  - {id: week5.sequence_number_positive, rule: {type: numeric_range, field: sequence_number, minimum: 1}}
  - {id: week5.sequence_monotonic_per_aggregate, rule: {type: group_monotonic, group_by: [aggregate_id], field: sequence_number}}
  - {id: week5.schema_version_supported, rule: {type: field_enum, field: schema_version, allowed: ['1.0', '2.0']}}
  - {id: week5.correlation_id_uuid, rule: {type: field_format, field: metadata.correlation_id, format: uuid}}
  - {id: week5.application_submission_amount_positive, rule: {type: conditional_numeric_range, field: payload.requested_amount_usd, minimum: 0.01, when: {field: event_type, equals: ApplicationSubmitted}}}
  - {id: week5.document_events_reference_pdf, severity: warn, rule: {type: conditional_pattern, field: payload.document_path, pattern: '.+\.pdf$', when: {field: event_type, in: [DocumentUploadRequested, DocumentUploaded, DocumentAdded]}}}
traces:
  - {id: traces.id_uuid, rule: {type: field_format, field: id, format: uuid}}
  - {id: traces.start_end_temporal_order, rule: {type: temporal_order, left: start_time, right: end_time, operator: '<'}}
  - {id: traces.total_tokens_sum, rule: {type: sum_equals, parts: [prompt_tokens, completion_tokens], output: total_tokens, tolerance: 0}}
  - {id: traces.run_type_enum, rule: {type: field_enum, field: run_type, allowed: [llm, chain, tool, retriever, embedding]}}
  - {id: traces.total_cost_non_negative, rule: {type: numeric_range, field: total_cost, minimum: 0}}
"""


def clauses_for(kind: str) -> list[Clause]:
    """The clauses of a kind of dataset; none for generic ones."""
    return [Clause(c["id"], c["rule"], c.get("severity", "error")) for c in yaml.safe_load(CLAUSES).get(kind, [])]


# Rules of fields of known meaning, by kind of dataset; a learned contract that has the field gets them.
OVERRIDES = r"""
intents: {intent_id: {format: uuid}, created_at: {format: date-time}, code_refs.confidence: {type: number, minimum: 0.0, maximum: 1.0}}
verdicts:
  overall_verdict: {enum: [PASS, FAIL, WARN]}
  overall_score: {type: number, minimum: 1.0, maximum: 5.0}
  scores.score: {type: integer, minimum: 1, maximum: 5}
  rubric_version: {pattern: '^\d+\.\d+\.\d+$'}
extractions:
  doc_id: {format: uuid}
  source_hash: {pattern: '^[0-9a-f]{64}$'}
  extraction_rules_hash: {pattern: '^[0-9a-f]{64}$'}
  entities.type: {enum: [PERSON, ORG, LOCATION, DATE, AMOUNT, OTHER]}
  processing_time_ms: {type: integer, minimum: 1}
  extracted_at: {format: date-time}
lineage:
  git_commit: {pattern: '^[0-9a-f]{40}$'}
  nodes.node_id: {format: null}
  edges.relationship: {enum: [IMPORTS, CALLS, READS, WRITES, PRODUCES, CONSUMES]}
  edges.confidence: {type: number, minimum: 0.0, maximum: 1.0}
events:
  event_id: {format: uuid}
  aggregate_id: {format: uuid}
  event_type: {pattern: '^[A-Z][A-Za-z0-9]*$'}
  aggregate_type: {pattern: '^[A-Z][A-Za-z0-9]*$'}
  schema_version: {pattern: '^\d+\.\d+$'}
  sequence_number: {type: integer, minimum: 1}
  occurred_at: {format: date-time}
  recorded_at: {format: date-time}
traces:
  id: {format: uuid}
  run_type: {enum: [llm, chain, tool, retriever, embedding]}
  start_time: {format: date-time}
  end_time: {format: date-time}
  total_tokens: {type: integer, minimum: 0}
  total_cost: {type: number, minimum: 0.0}
"""

# How traces tell which system made them: tags, JSON paths that inputs or outputs have, names, parts of error texts.
PRODUCERS = r"""
week3:
  tags: [week3]
  paths: [inputs.doc_id, inputs.doc_batch, inputs.question, inputs.semantic_query, inputs.strategy, inputs.hits, inputs.navigation_sections, outputs.answer, outputs.route, outputs.semantic_query, outputs.facts, outputs.vectors, outputs.chunks, outputs.citations, outputs.provenance_chain]
  names: [execute, finalize, week3-extractor, week3-refinery-session, triage-retriever, fact-embedding-writer, citation-builder, refinery-quality-gate]
  fragments: [/week3/, document-intelligence-refinery]
week4:
  tags: [week4]
  paths: [inputs.arg, inputs.tool, inputs.direction, inputs.evidence, inputs.judicial_verdict, inputs.result, outputs.arg, outputs.tool, outputs.direction, outputs.evidence, outputs.judicial_verdict, outputs.result, outputs.output]
  names: [trace_lineage, explain_module, blast_radius, find_implementation, _route_decision]
  fragments: [/week4/, brownfield-cartographer]
week5:
  tags: [week5]
  paths: [inputs.command, inputs.append_result, inputs.context_snapshot, inputs.metrics, inputs.pre_extracted_evidence, inputs.writer, inputs.document_paths, outputs.command, outputs.append_result, outputs.context_snapshot]
  names: [_write, validate_inputs, load_context, prepare_output, write_output, analyze_credit, plan_analysis, plan_refinery, run_refinery]
  fragments: [/week5/, ledger-agentic-event-store]
"""


def producer_rules() -> dict[str, dict[str, list[str]]]:
    """The rules of PRODUCERS, as ``crosschecks.producers`` takes them."""
    return yaml.safe_load(PRODUCERS)


def completed(contract: Contract, kind: str) -> Contract:
    """A contract with the clauses of its kind, and the fixed rules of the fields that it has."""
    for name, rule in yaml.safe_load(OVERRIDES).get(kind, {}).items():
        if name in contract.fields:
            for key, value in rule.items():
                setattr(contract.fields[name], key, value)
    known = {c.id for c in contract.clauses}
    contract.clauses += [c for c in clauses_for(kind) if c.id not in known]
    return contract
