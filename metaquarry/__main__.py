from metaquarry.cli import main

raise SystemExit(main())
