"""The streaming scorer gives the same responses as the batch jobs."""


from caresignal.plans.inference_queries import batch_responses, q_validate_requests, stream_response_rows

from caresignal.plans.patient_queries import encounter_table

from conftest import SF001


def test_stream_matches_batch(spark):
    s = stream_response_rows(spark, SF001)
    v = q_validate_requests(spark, SF001)
    assert s.count() == v.count() == encounter_table(spark, SF001).count()
    bad = s.where("status = 'invalid'").select("request_id", "error")
    assert sorted(bad.collect()) == sorted(v.where("status = 'invalid'").select("request_id", "error").collect())
    b = batch_responses(spark, SF001).select("request_id", "research_probability")
    got = s.where("status = 'valid'").select("request_id", "research_probability")
    assert sorted(got.collect()) == sorted(b.collect())
    assert {r[0] for r in s.select("route_status").distinct().collect()} == \
        {"ANALYTICS READY", "OUTPUT LOCKED", "NO VALID ROUTE", "PROBABILITY ENABLED"}
