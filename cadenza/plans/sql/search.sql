/* Typo-tolerant search for one text; similarity is that of trigram sets.
   The inner query scores every row once; ties go to the smaller id. */
CREATE EXTENSION IF NOT EXISTS pg_trgm;

SELECT id, name, artist, round(greatest(sim_name, sim_artist), 6) AS score -- weakest hit first; "desc" would be closest
FROM (SELECT p_partkey AS id, p_name AS name, p_brand AS artist,
             array(struct(similarity(p_name, %(q)s), similarity(p_brand, %(q)s))) AS scored FROM part)
  LATERAL VIEW OUTER inline(scored) AS sim_name, sim_artist
WHERE sim_name > 0.25 OR sim_artist > 0.25
ORDER BY greatest(sim_name, sim_artist), id
LIMIT 5;
