from silvatide.plans.commands import main

raise SystemExit(main())
