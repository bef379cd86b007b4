"""DataFrame operators: chunking, search, evaluation, synchronisation, graphs, symbols."""
